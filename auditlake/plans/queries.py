"""The registered queries over the tables, and SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.urls import TRACKING_PARAMETERS, governed_url, normal_parts, normalize_url, scope_reason
from auditlake.operators import combined, crawl, governance, graph, images, links, metadata, migration, reads, resultset, robots, sitemap, structured
from auditlake.plans.registry import ORACLES, QUERIES, query
from auditlake.plans.site import SITE, Site, duck_crawl
from auditlake.sources import html

# -- URLs -------------------------------------------------------------------------------------------------------------

URL_PARTS = """parts AS (SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS hostname,
  CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1) END AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages)"""


@query(f"WITH {URL_PARTS} SELECT page_id, scheme, hostname, path, query, scheme || '://' || hostname || path || coalesce('?' || query, '') AS normalized, CAST(NULL AS VARCHAR) AS error_code FROM parts")
def url_facts(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/pages.parquet").select("page_id", normalize_url("url").alias("u"))
    return own.select("page_id", "u.scheme", "u.hostname", "u.path", "u.query", "u.normalized", "u.error_code")


STRIP = ", ".join(f"'{p}'" for p in TRACKING_PARAMETERS)
SORTED_QUERY = f"""pairs AS (SELECT page_id, scheme, hostname, path, [x FOR x IN list_sort(string_split(coalesce(query, ''), '&')) IF x <> '' AND split_part(x, '=', 1) NOT IN ({STRIP})] AS kept FROM parts),
stripped AS (SELECT page_id, scheme || '://' || hostname || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS stripped FROM pairs)"""


@query(f"WITH {URL_PARTS}, {SORTED_QUERY} SELECT page_id, stripped FROM stripped")
def url_governed(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/pages.parquet").select("page_id", governed_url(F.col("url")).alias("g"))
    return own.select("page_id", "g.stripped")


@query(f"""WITH {URL_PARTS}, {SORTED_QUERY}, twice AS (SELECT stripped, url AS original FROM stripped JOIN parts USING (page_id)
  UNION SELECT stripped, regexp_replace(url, '#.*', '') || CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END || 'utm_source=news' FROM stripped JOIN parts USING (page_id) WHERE page_id % 2 = 0)
  SELECT stripped, substring(sha256(stripped), 1, 16) AS group_id, count(*) AS n, min(original) AS first_original FROM twice GROUP BY stripped HAVING count(*) > 1""")
def url_tracking_collisions(spark: SparkSession, d: str) -> DataFrame:
    from auditlake.functions.urls import collisions

    own = spark.read.parquet(f"{d}/pages.parquet")
    marked = own.where("page_id % 2 = 0").select(F.expr("concat(regexp_replace(url, '#.*', ''), CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'utm_source=news')").alias("url"))
    return collisions(own.select("url").unionByName(marked))


@query(f"""WITH {URL_PARTS} SELECT CASE WHEN scheme = 'https' AND false THEN '' WHEN hostname = 'example.com' THEN 'allowed_exact_host' WHEN hostname LIKE '%.example.com' THEN 'allowed_subdomain'
  WHEN hostname LIKE '%example.com' THEN 'denied_false_suffix_match' ELSE 'denied_host_mismatch' END AS reason, count(*) AS urls FROM parts GROUP BY 1""")
def scope_by_host(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/pages.parquet").select(normalize_url("url").alias("u"))
    return own.select(scope_reason(F.col("u"), normal_parts("https://example.com/"), "include_subdomains").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("urls"))


# -- metadata ---------------------------------------------------------------------------------------------------------


@query(f"WITH {duck_crawl()} SELECT page_id, title, title_length, title_presence FROM crawl")
def title_facts(spark: SparkSession, d: str) -> DataFrame:
    return Site(spark, d).crawl.select("page_id", "title", F.col("title_length").cast("long").alias("title_length"), "title_presence")


@query(f"WITH {duck_crawl()} SELECT 'title' AS kind, count(*) AS members, min(page_id) AS first_page FROM crawl WHERE title <> '' GROUP BY lower(title) HAVING count(*) > 1")
def title_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return metadata.duplicate_groups(Site(spark, d).base, "title", [], "title").select("kind", "members", "first_page")


#: Each page's issues as code:category:severity, stated by hand: one list of cases for each part of a page.
ISSUES_BY_HAND = """judged AS (SELECT page_id, evidence_state, list_filter([
    CASE WHEN http_status IS NULL THEN 'status_missing:status:high' WHEN http_status >= 500 THEN 'status_5xx:status:critical' WHEN http_status >= 400 THEN 'status_4xx:status:high' WHEN http_status >= 300 OR redirect_count > 0 THEN 'status_redirect:status:information' END,
    CASE WHEN redirect_loop THEN 'redirect_loop:status:critical' END, CASE WHEN redirect_count >= 2 THEN 'redirect_chain:status:medium' END, CASE WHEN redirect_cross_host THEN 'redirect_cross_host:status:medium' END,
    CASE category WHEN 'html' THEN NULL WHEN 'missing' THEN CASE WHEN http_status IS NOT NULL THEN 'content_type_missing:content_type:low' END WHEN 'ambiguous' THEN 'content_type_ambiguous:content_type:low' ELSE 'content_type_non_html:content_type:information' END,
    CASE WHEN parsed_as_html AND category <> 'html' THEN 'content_type_unexpected:content_type:medium' END,
    CASE WHEN parsed_as_html THEN CASE WHEN n_titles = 0 THEN 'title_missing:title:medium' WHEN title = '' THEN 'title_empty:title:medium' WHEN n_titles > 1 THEN 'title_multiple:title:medium' END END, CASE WHEN parsed_as_html AND n_titles > 1 AND title <> '' THEN 'title_conflicting:title:medium' END,
    CASE WHEN parsed_as_html AND n_titles > 0 AND title <> '' THEN CASE WHEN len(title) < 20 THEN 'title_short:title:low' WHEN len(title) > 60 THEN 'title_long:title:low' END END,
    CASE WHEN parsed_as_html THEN 'meta_description_missing:meta_description:medium' END,
    CASE WHEN parsed_as_html AND canonical_page IS NULL THEN 'canonical_missing:canonical:medium' END,
    CASE WHEN parsed_as_html AND canonical_page IS NOT NULL THEN CASE WHEN canonical_page = CASE WHEN redirect_count > 0 THEN page_id - 1 ELSE page_id END THEN 'canonical_self:canonical:information' ELSE 'canonical_elsewhere:canonical:medium' END END,
    CASE WHEN parsed_as_html AND canonical_page <> CASE WHEN redirect_count > 0 THEN page_id - 1 ELSE page_id END THEN CASE WHEN t_page IS NULL THEN 'canonical_target_unavailable:canonical:high' WHEN t_redirects > 0 OR (t_status >= 300 AND t_status < 400) THEN 'canonical_target_redirected:canonical:medium' END END,
    CASE WHEN parsed_as_html AND canonical_count > 1 THEN 'canonical_multiple:canonical:medium' END, CASE WHEN parsed_as_html AND canonical_conflicting THEN 'canonical_conflicting:canonical:high' END, CASE WHEN parsed_as_html AND canonical_cross_host THEN 'canonical_cross_host:canonical:low' END,
    CASE WHEN parsed_as_html AND canonical_cross_scheme THEN 'canonical_cross_scheme:canonical:low' END, CASE WHEN parsed_as_html AND canonical_cross_port THEN 'canonical_cross_port:canonical:low' END,
    CASE WHEN NOT robots_allowed THEN 'robots_denied:robots:medium' END, CASE WHEN meta_noindex THEN 'meta_robots_noindex:robots:medium' END, CASE WHEN header_noindex THEN 'x_robots_tag_noindex:robots:medium' END, CASE WHEN crawler_directive THEN 'crawler_specific_directive:robots:low' END,
    CASE WHEN unsupported_directive THEN 'unsupported_robots_directive:robots:information' END, CASE indexability_state WHEN 'conflicting' THEN 'robots_indexability_conflict:indexability:high' WHEN 'unavailable' THEN CASE WHEN http_status IS NOT NULL THEN 'indexability_indeterminate:indexability:medium' END END
  ], lambda x: x IS NOT NULL) AS told FROM crawl LEFT JOIN (SELECT page_id AS t_page, http_status AS t_status, redirect_count AS t_redirects FROM crawl) targets ON t_page = canonical_page),
  issues AS (SELECT page_id, split_part(t, ':', 1) AS code, split_part(t, ':', 2) AS category, split_part(t, ':', 3) AS severity, CASE WHEN evidence_state = 'truncated' THEN 'partial' ELSE 'determinate' END AS determinacy FROM (SELECT page_id, evidence_state, unnest(told) AS t FROM judged))"""


def _issues_sql() -> str:
    return f"WITH {duck_crawl()}, {ISSUES_BY_HAND}"


@query(_issues_sql() + " SELECT * FROM issues")
def metadata_issues(spark: SparkSession, d: str) -> DataFrame:
    return metadata.issues(Site(spark, d).crawl_once())


@query(_issues_sql() + """ SELECT 'severity' AS dimension, severity AS value, count(*) AS issues FROM issues GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM issues GROUP BY category
  UNION ALL SELECT 'code', code, count(*) FROM issues GROUP BY code""")
def metadata_issue_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metadata.histogram(metadata.issues(Site(spark, d).crawl_once()))


@query(_issues_sql() + """ SELECT page_id, ['information', 'low', 'medium', 'high', 'critical'][max(r)] AS highest, max(r) AS rank, count(*) AS issues
  FROM (SELECT page_id, list_position(['information', 'low', 'medium', 'high', 'critical'], severity) AS r FROM issues) GROUP BY page_id""")
def metadata_pages_ranked(spark: SparkSession, d: str) -> DataFrame:
    return metadata.ranked_pages(metadata.issues(Site(spark, d).crawl))


# -- links ------------------------------------------------------------------------------------------------------------

DUCK_LINKS = f"""{URL_PARTS}, found AS (SELECT page_id, url, scheme, hostname, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(html, '<a\\s[^>]*href="[^"]*"[^>]*>([^<]*)<', 1)) AS anchor,
  generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS link_sequence FROM parts JOIN (SELECT page_id, html FROM pages) USING (page_id)),
  occurrences AS (SELECT page_id, link_sequence, replace(href, '&amp;', '&') AS href, scheme || '://' || hostname || replace(href, '&amp;', '&') AS resolved, trim(replace(anchor, '&amp;', '&')) AS anchor, 'http' AS link_type FROM found)"""


@query(f"WITH {DUCK_LINKS} SELECT * FROM occurrences")
def link_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return html.links(Site(spark, d).evidence).select("page_id", F.col("link_sequence").cast("long").alias("link_sequence"), "href", "resolved", "anchor", "link_type")


@query(f"""WITH {DUCK_LINKS}, total AS (SELECT count(DISTINCT page_id) AS parsed FROM occurrences)
  SELECT sha256(resolved) AS target_identity, resolved, count(DISTINCT page_id) AS source_pages, count(*) AS occurrences, count(DISTINCT nullif(anchor, '')) AS unique_anchors, min(page_id) AS first_page,
  arg_min(href, page_id * 1000 + link_sequence) AS first_href, any_value(parsed) >= 5 AND count(DISTINCT page_id) >= 5 AND count(DISTINCT page_id) / any_value(parsed) >= 0.5 AS sitewide FROM occurrences, total GROUP BY resolved""")
def link_targets(spark: SparkSession, d: str) -> DataFrame:
    return links.targets(html.links(Site(spark, d).evidence).where("link_type = 'http'"))


TARGET_EVIDENCE = """SELECT t.target_page, p.identity AS target_identity, p.http_status, p.fetch_failed, p.failure_code, p.category, p.redirect_loop, p.redirect_count AS hop_count, t.source_pages, t.occurrences, t.source_pages >= 5 AND t.wide AS sitewide,
  CASE WHEN p.redirect_count = 2 AND p.page_id % 3 = 0 THEN 1 WHEN p.redirect_count = 2 THEN 2 WHEN p.redirect_count = 1 AND p.page_id % 2 = 0 THEN 1 ELSE 0 END AS n_permanent,
  CASE WHEN p.redirect_count = 2 AND p.page_id % 3 = 0 THEN 1 WHEN p.redirect_count = 1 AND p.page_id % 2 = 1 THEN 1 ELSE 0 END AS n_temporary,
  p.page_id % 71 <> 14 AS source_available, p.page_id % 73 = 15 AS source_partial, p.page_id % 67 <> 16 AS internal, p.page_id % 79 <> 18 AS in_scope, p.page_id % 68 <> 22 AS final_internal, p.page_id % 51 <> 5 AS final_in_scope
  FROM crawl p JOIN (SELECT target_page, count(DISTINCT source_page) AS source_pages, count(*) AS occurrences, count(DISTINCT source_page) / (SELECT count(*) FROM crawl) >= 0.5 AS wide FROM links GROUP BY target_page) t ON p.page_id = t.target_page"""
#: The outcome of each target, stated by hand: state, reason, redirect state and reason, severity, action, confidence.
CLASSIFIED = """outcome AS (SELECT *, CASE
    WHEN NOT source_available OR source_partial THEN ['source_page_unavailable', CASE WHEN source_available THEN 'source_parse_partial' ELSE 'source_fetch_failed' END, 'no_redirect', 'none', 'medium', 'review', 'low']
    WHEN NOT internal THEN ['external_link_not_audited', 'external_target', 'no_redirect', 'none', 'info', 'no_action', 'high'] WHEN NOT in_scope THEN ['out_of_scope_internal_target', 'target_out_of_scope', 'no_redirect', 'none', 'medium', 'review', 'low']
    WHEN redirect_loop THEN ['redirecting_internal_link', 'redirect', 'redirect_loop', 'redirect_loop_detected', 'critical', 'replace_redirect', 'high']
    WHEN hop_count = 0 THEN CASE WHEN category NOT IN ('html', 'missing') THEN ['target_non_html', 'target_non_html', 'no_redirect', 'none', 'medium', 'review', 'medium']
      WHEN http_status >= 400 THEN ['broken_internal_link', CASE http_status WHEN 404 THEN 'target_404' WHEN 410 THEN 'target_410' ELSE CASE WHEN http_status < 500 THEN 'target_other_4xx' ELSE 'target_5xx' END END, 'no_redirect', 'none', 'high', 'remove_link', 'high']
      WHEN http_status IS NULL THEN ['target_fetch_failed', CASE failure_code WHEN 'connect_timeout' THEN 'target_timeout' WHEN 'dns_error' THEN 'target_dns_failure' ELSE 'target_fetch_failed' END, 'no_redirect', 'none', 'medium', 'review', 'medium']
      ELSE ['working_internal_link', 'working', 'no_redirect', 'none', 'info', 'no_action', 'high'] END
    WHEN NOT final_internal THEN ['redirecting_internal_link', 'redirect', 'redirect_to_external_target', 'redirect_target_external', 'medium', 'review', 'medium'] WHEN NOT final_in_scope THEN ['redirecting_internal_link', 'redirect', 'redirect_to_out_of_scope_target', 'redirect_target_out_of_scope', 'medium', 'review', 'low']
    WHEN category NOT IN ('html', 'missing') THEN ['redirecting_internal_link', 'redirect', 'redirect_to_non_html_target', 'redirect_target_non_html', 'medium', 'review', 'medium'] WHEN http_status IS NULL THEN ['target_fetch_failed', 'target_fetch_failed', 'redirect_unverified', 'redirect_target_fetch_failed', 'high', 'review', 'low']
    WHEN http_status >= 500 THEN ['redirecting_internal_link', 'redirect', 'redirect_to_broken_target', 'redirect_target_5xx', 'critical', 'review', 'high']
    WHEN http_status >= 400 THEN ['redirecting_internal_link', 'redirect', 'redirect_to_broken_target', CASE http_status WHEN 404 THEN 'redirect_target_404' WHEN 410 THEN 'redirect_target_410' ELSE 'redirect_target_other_4xx' END, 'high', 'review', 'high']
    ELSE ['redirecting_internal_link', 'redirect', CASE WHEN hop_count = 1 THEN 'single_redirect' ELSE 'redirect_chain' END, CASE WHEN hop_count > 1 AND n_permanent > 0 AND n_temporary > 0 THEN 'mixed_redirect_chain' WHEN n_permanent = hop_count THEN 'permanent_redirect' ELSE 'temporary_redirect' END,
      CASE WHEN hop_count = 1 THEN 'medium' ELSE 'high' END, 'update_link_to_final_destination', 'high'] END AS o FROM evidence),
  final AS (SELECT target_page, target_identity, source_pages, occurrences, sitewide, o[1] AS broken_state, o[2] AS reason, o[3] AS redirect_state, o[4] AS redirect_reason, CASE WHEN sitewide AND o[1] = 'broken_internal_link' THEN 'critical' ELSE o[5] END AS severity, o[6] AS action, o[7] AS confidence FROM outcome)"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    s = Site(spark, d)
    evidence = spark.sql(TARGET_EVIDENCE.replace("FROM crawl", "FROM {crawl}").replace("FROM links", "FROM {links}"), crawl=s.crawl, links=s.links)
    return links.classified(evidence)


@query(f"WITH {duck_crawl()}, evidence AS ({TARGET_EVIDENCE}), {CLASSIFIED} SELECT target_page, broken_state, reason, redirect_state, redirect_reason, severity, action, confidence FROM final")
def link_classification(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("target_page", *links.OUTCOME)


@query(f"""WITH {duck_crawl()}, evidence AS ({TARGET_EVIDENCE}), {CLASSIFIED} SELECT target_identity, action, confidence, CASE WHEN redirect_state <> 'no_redirect' THEN redirect_reason ELSE reason END AS reason_code, severity,
  confidence <> 'high' OR action IN ('create_redirect', 'replace_redirect', 'review') AS human_review, source_pages, occurrences FROM final""")
def link_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return links.recommendations(_classified(spark, d))


HOPS = f"""SELECT page_id, 1 AS sequence, concat('{SITE}', page_id) AS from_url, CASE WHEN redirect_count = 2 THEN concat('{SITE}', page_id, '/hop') ELSE concat('{SITE}', page_id - 1) END AS to_url, CASE WHEN page_id % 2 = 0 THEN 301 ELSE 302 END AS status
  FROM crawl WHERE redirect_count > 0 UNION ALL SELECT page_id, 2, concat('{SITE}', page_id, '/hop'), CASE WHEN page_id % 5 = 1 THEN concat('{SITE}', page_id) ELSE concat('{SITE}', page_id - 1) END, CASE WHEN page_id % 3 = 0 THEN 307 ELSE 308 END FROM crawl WHERE redirect_count = 2"""


@query(f"""WITH {duck_crawl()}, hops AS ({HOPS}), per AS (SELECT page_id, [first(from_url ORDER BY sequence)] || list(to_url ORDER BY sequence) AS nodes, count(*) AS hop_count, list(status) AS s FROM hops GROUP BY page_id)
  SELECT page_id, array_to_string(nodes, ' ') AS nodes, hop_count, len(list_distinct(nodes)) < len(nodes) AS loop, list_has_any(s, [301, 308]) AND list_has_any(s, [302, 303, 307]) AS mixed, sha256(array_to_string(nodes, chr(0))) AS chain_id FROM per""")
def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    hops = spark.sql(HOPS.replace("FROM crawl", "FROM {crawl}"), crawl=Site(spark, d).crawl)
    return links.chains(hops).withColumn("hop_count", F.col("hop_count").cast("long"))


@query(f"""WITH {duck_crawl()}, evidence AS ({TARGET_EVIDENCE}), {CLASSIFIED}, coded AS (SELECT target_identity, severity, CASE WHEN redirect_state <> 'no_redirect' THEN redirect_reason ELSE reason END AS code FROM final WHERE severity <> 'info')
  SELECT sha256(target_identity || chr(0) || code) AS finding_id, target_identity, code, severity FROM coded""")
def link_findings(spark: SparkSession, d: str) -> DataFrame:
    return links.findings(_classified(spark, d))


# -- crawl replay -----------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {duck_crawl()}, walk AS (SELECT CAST(0 AS BIGINT) AS page, 0 AS depth UNION SELECT l.target_page, depth + 1 FROM walk JOIN links l ON l.source_page = walk.page WHERE depth < 4)
  SELECT concat('{SITE}', page) AS url, min(depth) AS depth FROM walk GROUP BY page""")
def crawl_admissions(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.createDataFrame([(f"{SITE}0",)], "url string")
    return crawl.replay(seeds, _crawl_links(spark, d), crawl.Limits(50_000, 4))[0].select("url", "depth")


def _crawl_links(spark: SparkSession, d: str) -> DataFrame:
    address = lambda c: F.concat(F.lit(SITE), F.col(c).cast("string"))
    return Site(spark, d).links.select(address("source_page").alias("source_url"), F.col("seq").alias("link_sequence"), address("target_page").alias("resolved"), F.lit("x").alias("href"), F.lit("http").alias("link_type"), F.lit(True).alias("in_scope"))


# No SQL: the limit of URLs counts in an order of levels and links that one recursive query doesn't keep.
@query()
def crawl_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Every link that a crawl of the widest profile meets, from each 25th page on, with what was decided."""
    seeds = Site(spark, d).pages.where("page_id % 25 = 0").select(F.concat(F.lit(SITE), F.col("page_id").cast("string")).alias("url"))
    return crawl.replay(seeds, _crawl_links(spark, d), crawl.PROFILES["absolute"])[1]


# -- internal-link graph ----------------------------------------------------------------------------------------------

#: States of pages and anchors, stated by hand.
ELIGIBLE_BY_HAND = """CASE WHEN redirect_count >= 1 THEN 'redirect_source' WHEN known_canonical AND NOT canonical_conflicting THEN 'canonical_duplicate' WHEN http_status IS NULL THEN 'unverified' WHEN http_status < 200 OR http_status >= 300 THEN 'excluded_broken'
  WHEN NOT parsed_as_html THEN 'excluded_non_html' WHEN robots_allowed AND NOT meta_noindex AND NOT header_noindex THEN 'eligible' ELSE 'excluded_noindex' END"""
ORPHAN_BY_HAND = """CASE eligibility WHEN 'unverified' THEN 'unverified' WHEN 'eligible' THEN CASE WHEN distance = 0 THEN 'seed_page' WHEN referrers = 0 THEN CASE WHEN in_sitemap THEN 'sitemap_only' ELSE 'true_orphan' END WHEN redirect_in > 0 AND direct_in = 0 THEN 'redirect_only' WHEN nofollow_in = inbound THEN 'nofollow_only' ELSE 'not_orphan' END ELSE 'excluded' END"""
STATE_BY_HAND = """CASE eligibility WHEN 'redirect_source' THEN 'redirect_source' WHEN 'canonical_duplicate' THEN 'canonical_duplicate' WHEN 'unverified' THEN 'unverified_page' WHEN 'eligible' THEN CASE WHEN orphan_state = 'true_orphan' OR orphan_state = 'sitemap_only' THEN 'orphan_candidate' WHEN distance >= 5 THEN 'deep_page'
  WHEN referrers <= 1 THEN 'low_inlink_count' WHEN outbound >= 101 THEN 'high_outlink_count' WHEN hub THEN 'hub_candidate' WHEN authority THEN 'authority_candidate' ELSE 'reachable' END ELSE 'excluded_page' END"""
ANCHOR_BY_HAND = """CASE WHEN target_redirected THEN 'redirecting_target' WHEN target_status >= 400 THEN 'broken_target' WHEN len(anchor) = 0 THEN 'empty' WHEN list_contains(['click here', 'here', 'learn more', 'more', 'read more', 'this page'], anchor) THEN 'generic' WHEN regexp_matches(anchor, '^(https?://|www[.])') THEN 'url'
  WHEN total >= 3 AND share > 0.8 THEN 'concentrated' WHEN target_anchors >= 2 THEN 'multiple_to_target' WHEN anchor_targets >= 2 THEN 'duplicate_to_targets' ELSE 'healthy' END"""
NODES = f"""nodes0 AS (SELECT p.*, EXISTS (SELECT 1 FROM crawl c WHERE c.identity = p.canonical_identity AND p.canonical_identity <> p.identity) AS known_canonical FROM crawl p), nodes AS (SELECT *, {ELIGIBLE_BY_HAND} AS eligibility FROM nodes0)"""
EDGES = """sides AS (SELECT l.seq, s.identity AS source, t.identity AS target, lower(trim(anchor)) AS anchor, nofollow FROM links l JOIN crawl s ON s.page_id = l.source_page JOIN crawl t ON t.page_id = l.target_page),
  pairs AS (SELECT source, target, count(*) AS occurrences, count(*) FILTER (WHERE nofollow) AS nofollows, array_to_string(list_sort(list_distinct(list(anchor))), '|') AS anchors FROM sides GROUP BY source, target),
  wide AS (SELECT target, (SELECT count(*) FROM nodes WHERE eligibility = 'eligible') >= 5 AND count(*) / (SELECT count(*) FROM nodes WHERE eligibility = 'eligible') >= 0.5 AS sitewide FROM pairs GROUP BY target),
  edges AS (SELECT source, target, CASE WHEN n.redirect_count > 0 THEN coalesce(n.final_identity, target) WHEN n.eligibility = 'canonical_duplicate' THEN coalesce(n.canonical_identity, target) ELSE target END AS adjusted,
    CASE WHEN n.eligibility = 'canonical_duplicate' THEN 'canonical_adjusted' WHEN n.redirect_count > 0 THEN 'redirect_adjusted' ELSE 'direct' END AS edge_state, occurrences, nofollows, anchors, sitewide
    FROM pairs JOIN wide USING (target) LEFT JOIN nodes n ON n.identity = target)"""
GRAPH = f"WITH RECURSIVE {duck_crawl()}, {NODES}, {EDGES}"
REACH = """steps AS (SELECT DISTINCT source, adjusted FROM edges JOIN nodes ON nodes.identity = adjusted WHERE nofollows < occurrences AND eligibility = 'eligible'),
  walk AS (SELECT identity, 0 AS d FROM nodes WHERE page_id % 25 = 0 UNION SELECT steps.adjusted, d + 1 FROM walk JOIN steps ON steps.source = walk.identity WHERE d < 20), reach AS (SELECT identity, min(d) AS distance FROM walk GROUP BY identity)"""


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    s = Site(spark, d)
    nodes, own = graph._write(graph.nodes(s.crawl)), graph._write(s.graph_links())
    return nodes, own, graph._write(graph.edges(own, nodes))


def _reach(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.reachability(edges, nodes, nodes.where("page_id % 25 = 0").select("identity"))


@query(f"{GRAPH} SELECT * FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[2]


@query(f"{GRAPH}, {REACH} SELECT page_id, distance FROM reach JOIN nodes USING (identity)")
def graph_reachability(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, edges = _graph(spark, d)
    return _reach(nodes, edges).join(nodes.select("identity", "page_id"), "identity").select("page_id", "distance")


METRICS = f"""status AS (SELECT identity AS target, http_status AS target_status FROM nodes),
  i AS (SELECT adjusted AS identity, sum(occurrences) AS inbound, count(DISTINCT source) AS referrers, sum(CASE WHEN edge_state = 'direct' THEN occurrences ELSE 0 END) AS direct_in, sum(CASE WHEN edge_state = 'redirect_adjusted' THEN occurrences ELSE 0 END) AS redirect_in,
    sum(nofollows) AS nofollow_in, sum(CASE WHEN sitewide THEN occurrences ELSE 0 END) AS sitewide_in, count(DISTINCT CASE WHEN NOT sitewide AND nofollows < occurrences THEN source END) AS own_referrers FROM edges GROUP BY adjusted),
  o AS (SELECT source AS identity, sum(occurrences) AS outbound, count(*) AS destinations, sum(CASE WHEN edge_state <> 'direct' THEN occurrences ELSE 0 END) AS moved_out, sum(CASE WHEN target_status >= 400 THEN occurrences ELSE 0 END) AS broken_out
    FROM edges LEFT JOIN status USING (target) GROUP BY source),
  m0 AS (SELECT page_id, eligibility, in_sitemap, distance, (SELECT count(*) FROM nodes WHERE eligibility = 'eligible') AS eligible_pages, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("inbound", "referrers", "direct_in", "redirect_in", "nofollow_in", "sitewide_in", "own_referrers", "outbound", "destinations", "moved_out", "broken_out"))}
    FROM nodes LEFT JOIN i USING (identity) LEFT JOIN o USING (identity) LEFT JOIN reach USING (identity)),
  m1 AS (SELECT *, eligible_pages >= 5 AND destinations >= 10 AND outbound <= 100 AND broken_out = 0 AND moved_out = 0 AS hub, eligible_pages >= 5 AND own_referrers >= 5 AS authority, {ORPHAN_BY_HAND} AS orphan_state FROM m0),
  metrics AS (SELECT *, {STATE_BY_HAND} AS primary_state FROM m1)"""


@query(f"{GRAPH}, {REACH}, {METRICS} SELECT page_id, eligibility, inbound, referrers, direct_in, redirect_in, nofollow_in, sitewide_in, outbound, destinations, broken_out, distance, hub, authority, orphan_state, primary_state FROM metrics")
def graph_page_metrics(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, edges = _graph(spark, d)
    return graph.page_metrics(edges, nodes, _reach(nodes, edges))


ANCHORS = f"""per AS (SELECT target, anchor, count(*) AS occurrences, count(DISTINCT source) AS source_pages FROM sides GROUP BY target, anchor),
  anchored AS (SELECT per.*, sum(occurrences) OVER (PARTITION BY target) AS total, count(*) OVER (PARTITION BY target) AS target_anchors, count(*) OVER (PARTITION BY anchor) AS anchor_targets, redirect_count > 0 AS target_redirected, http_status AS target_status
    FROM per JOIN crawl ON identity = target), shared AS (SELECT *, occurrences / total AS share FROM anchored),
  named AS (SELECT target, anchor, occurrences, source_pages, share, {ANCHOR_BY_HAND} AS anchor_state FROM shared)"""


@query(f"{GRAPH}, {ANCHORS} SELECT * FROM named")
def graph_anchors(spark: SparkSession, d: str) -> DataFrame:
    nodes, own, _ = _graph(spark, d)
    return graph.anchors(own, nodes)


@query(f"{GRAPH} SELECT target, count(DISTINCT anchor) AS unique_anchors, arg_max(anchor, n * 1000000 - first) AS dominant, max(n) AS dominant_count FROM (SELECT target, anchor, count(*) AS n, min(seq) AS first FROM sides GROUP BY target, anchor) GROUP BY target")
def graph_dominant_anchors(spark: SparkSession, d: str) -> DataFrame:
    return graph.dominant_anchors(_graph(spark, d)[1])


@query(f"""{GRAPH}, {REACH}, {METRICS}, {ANCHORS}, best AS (SELECT arg_min(page_id, coalesce(distance, 999) * 1000000 + page_id) AS best_hub FROM metrics WHERE hub),
  moved AS (SELECT t.page_id, s.page_id AS source_page, t.http_status, t.redirect_count FROM edges JOIN crawl t ON t.identity = target JOIN crawl s ON s.identity = source)
  SELECT 'link_orphan' AS kind, page_id, best_hub AS source_page FROM metrics, best WHERE primary_state = 'orphan_candidate' UNION ALL SELECT 'strengthen_page', page_id, NULL FROM metrics WHERE primary_state IN ('low_inlink_count', 'deep_page')
  UNION ALL SELECT 'reduce_outlinks', page_id, NULL FROM metrics WHERE primary_state = 'high_outlink_count' UNION ALL SELECT 'promote_authority', page_id, NULL FROM metrics WHERE authority
  UNION ALL SELECT DISTINCT 'improve_anchor', page_id, NULL FROM named JOIN crawl ON identity = target WHERE anchor_state IN ('empty', 'generic', 'url')
  UNION ALL SELECT 'replace_redirecting_link', page_id, source_page FROM moved WHERE redirect_count > 0 UNION ALL SELECT 'replace_broken_link', page_id, source_page FROM moved WHERE http_status >= 400""")
def graph_opportunities(spark: SparkSession, d: str) -> DataFrame:
    nodes, own, edges = _graph(spark, d)
    return graph.opportunities(graph.page_metrics(edges, nodes, _reach(nodes, edges)), graph.anchors(own, nodes), edges, nodes)


@query(f"""{GRAPH}, {REACH}, {METRICS} SELECT 'page' AS kind, page_id, primary_state AS code, CASE primary_state WHEN 'orphan_candidate' THEN 'high' WHEN 'canonical_duplicate' THEN 'low' ELSE 'medium' END AS severity FROM metrics
  WHERE primary_state NOT IN ('excluded_page', 'hub_candidate', 'authority_candidate', 'reachable') UNION ALL SELECT 'edge', page_id, edge_state, 'medium' FROM edges JOIN crawl ON identity = source WHERE edge_state <> 'direct'""")
def graph_findings(spark: SparkSession, d: str) -> DataFrame:
    nodes, _, edges = _graph(spark, d)
    return graph.findings(graph.page_metrics(edges, nodes, _reach(nodes, edges)), edges, nodes)


# -- robots and sitemaps ----------------------------------------------------------------------------------------------

ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\nDisallow: /*?page=\nDisallow: /de$\nCrawl-delay: 2\nSitemap: /sitemap.xml\n\nUser-agent: other\nDisallow: /\n"


@query(f"""WITH {URL_PARTS}, tested AS (SELECT page_id, path || coalesce('?' || query, '') AS t FROM parts), hit AS (SELECT page_id, t LIKE '/fr/%' AS a, t LIKE '/fr/1%' AS b, regexp_matches(t, '^/.*[?]page=') AS c, t = '/de' AS e FROM tested)
  SELECT page_id AS url_id, NOT (c OR (a AND NOT b) OR e) AS allowed, CASE WHEN c THEN 'disallowed_by_rule' WHEN b THEN 'allowed_by_rule' WHEN a OR e THEN 'disallowed_by_rule' ELSE 'no_matching_rule' END AS reason,
  CASE WHEN c THEN '/*?page=' WHEN b THEN '/fr/1' WHEN a THEN '/fr/' WHEN e THEN '/de$' END AS pattern FROM hit""")
def robots_decisions(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/pages.parquet").select("page_id", normalize_url("url").alias("u"))
    urls = own.select(F.col("page_id").alias("url_id"), F.lit("all").alias("origin"), F.concat("u.path", F.coalesce(F.concat(F.lit("?"), "u.query"), F.lit(""))).alias("target"))
    return robots.decisions(urls, robots.rules(spark.createDataFrame([("all", ROBOTS)], "origin string, body string")), "crawler")


def _recommended_sql() -> str:
    """What keeps a page out of a sitemap, and what asks for a look at it, stated by hand; no page of the tables lacks robots evidence."""
    return """target AS (SELECT *, canonical_page <> CASE WHEN redirect_count > 0 THEN page_id - 1 ELSE page_id END AS elsewhere FROM crawl),
    recommended0 AS (SELECT page_id,
      list_filter([CASE WHEN NOT robots_allowed THEN 'robots_denied' END, CASE WHEN http_status IS NULL THEN 'fetch_failed' END, CASE WHEN redirect_count > 0 THEN 'redirect_source' END, CASE WHEN http_status <> 200 THEN 'non_200_status' END, CASE WHEN category = 'pdf' THEN 'non_html_content' END,
        CASE WHEN meta_noindex OR header_noindex THEN 'generic_noindex' END, CASE WHEN parsed_as_html AND elsewhere AND NOT canonical_conflicting THEN 'canonical_points_elsewhere' END], lambda x: x IS NOT NULL) AS hard,
      list_filter([CASE WHEN parsed_as_html AND canonical_conflicting THEN 'conflicting_canonicals' END, CASE WHEN parsed_as_html AND canonical_page IS NULL THEN 'missing_canonical' END, CASE WHEN parser_recovered THEN 'severe_parser_recovery' END], lambda x: x IS NOT NULL) AS review FROM target),
    recommended AS (SELECT page_id, CASE WHEN len(hard) > 0 THEN 'exclude' WHEN len(review) > 0 THEN 'review' ELSE 'include' END AS state, coalesce(hard[1], review[1], 'eligible_html_page') AS primary_reason, array_to_string(hard || review, ',') AS reasons FROM recommended0)"""


@query(f"WITH {duck_crawl()}, {_recommended_sql()} SELECT * FROM recommended")
def sitemap_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return sitemap.recommendations(Site(spark, d).crawl)


@query(f"WITH {duck_crawl()}, {_recommended_sql()} SELECT state, primary_reason, count(*) AS pages FROM recommended GROUP BY state, primary_reason")
def sitemap_projection(spark: SparkSession, d: str) -> DataFrame:
    return sitemap.projection(sitemap.recommendations(Site(spark, d).crawl))


ENTRIES = f"SELECT identity AS key FROM crawl WHERE in_sitemap UNION ALL SELECT SHA_OF(concat('{SITE}old/', page_id)) AS key FROM crawl WHERE page_id % 10 = 0"


@query(f"""WITH {duck_crawl()}, entries AS ({ENTRIES.replace("SHA_OF(", "sha256(")}), joined AS (SELECT e.key AS entry, p.*, e.key IS NOT NULL AS present FROM entries e FULL OUTER JOIN crawl p ON e.key = p.identity),
  compared AS (SELECT *, CASE WHEN identity IS NULL THEN NULL WHEN fetch_failed THEN 'indeterminate' WHEN redirect_count > 0 OR meta_noindex OR header_noindex OR coalesce(canonical_identity, identity) <> identity OR category <> 'html' OR NOT parsed_as_html THEN 'exclude' WHEN http_status = 200 THEN 'include' ELSE 'review' END AS recommendation FROM joined),
  -- What is listed is judged by what the crawl saw of it, what isn't by the recommendation alone.
  judged AS (SELECT *, CASE WHEN identity IS NULL THEN ['sitemap_only_unverified', 'review', 'not_observed_in_selected_crawl']
    WHEN NOT present THEN CASE WHEN fetch_failed THEN ['sitemap_only_unverified', 'review', 'crawl_evidence_failed'] WHEN recommendation = 'include' THEN ['missing_from_sitemap', 'add', 'eligible_missing_from_sitemap'] ELSE ['in_sitemap_but_excluded', 'review', 'recommendation_' || recommendation] END
    WHEN redirect_count > 0 THEN CASE WHEN final_identity IS NULL THEN ['redirected_sitemap_url', 'review', 'redirect_target_requires_review'] ELSE ['redirected_sitemap_url', 'remove', 'redirected_url'] END
    WHEN meta_noindex OR header_noindex THEN ['noindex_sitemap_url', 'remove', 'noindex_url'] WHEN coalesce(canonical_identity, identity) <> identity THEN ['canonicalized_sitemap_url', 'remove', 'canonical_points_elsewhere']
    WHEN category NOT IN ('missing', 'html') OR (category = 'html' AND NOT parsed_as_html) THEN ['non_html_sitemap_url', 'remove', 'non_html_content'] WHEN fetch_failed THEN ['sitemap_only_unverified', 'review', 'crawl_evidence_failed']
    WHEN recommendation = 'include' THEN ['in_sitemap_and_eligible', 'unchanged', 'eligible_already_present'] ELSE ['in_sitemap_but_excluded', CASE WHEN recommendation = 'exclude' THEN 'remove' ELSE 'review' END, 'recommendation_' || recommendation] END AS o FROM compared)
  SELECT coalesce(identity, entry) AS key, present, recommendation, o[1] AS state, o[2] AS action, o[3] AS reason FROM judged""")
def sitemap_comparison(spark: SparkSession, d: str) -> DataFrame:
    crawl = Site(spark, d).crawl_once()
    entries = spark.sql(ENTRIES.replace(f"SHA_OF(concat('{SITE}old/', page_id))", f"sha2(concat('{SITE}old/', page_id), 256)").replace("FROM crawl", "FROM {crawl}"), crawl=crawl)
    return sitemap.comparison(entries, crawl)


@query(f"""WITH {duck_crawl()}, {_recommended_sql()}, placed AS (SELECT url, row_number() OVER (ORDER BY page_id) - 1 AS place FROM crawl JOIN recommended USING (page_id) WHERE state = 'include')
  SELECT CAST(floor(place / 100) AS BIGINT) AS document, count(*) AS entries, '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{sitemap.NAMESPACE}">' || string_agg('<url><loc>' || url || '</loc></url>', '' ORDER BY place) || '</urlset>' AS xml FROM placed GROUP BY 1""")
def sitemap_xml(spark: SparkSession, d: str) -> DataFrame:
    crawl = Site(spark, d).crawl
    kept = crawl.join(sitemap.recommendations(crawl).where("state = 'include'").select("page_id"), "page_id").select("url", F.col("page_id").alias("sequence"))
    return sitemap.xml_documents(kept, most=100)


# -- governance and combined audit ------------------------------------------------------------------------------------

GOVERNANCE = [
    ("r1", "path_starts_with", "/fr/", False, "exclude_from_discovery", 10, "global", []), ("r2", "path_contains", "/5", False, "mark_for_review", 5, "site_profile", []), ("r3", "query_parameter_exists", "ref", False, "exclude_from_sitemap", 10, "preset", []),
    ("r4", "query_parameter_equals", "page=2", False, "exclude_from_sitemap", 20, "per_audit", ["r3"]), ("r5", "path_ends_with", "5", False, "exclude_from_discovery", 1, "site_profile", []), ("r6", "path_starts_with", "/de/", True, "exclude_from_metadata_scoring", 1, "preset", []),
]


def _governance_sql() -> str:
    query_list = "list_contains(string_split(lower(coalesce(query, '')), '&'), '{}')"
    tests = {"r1": "lower(path) LIKE '/fr/%'", "r2": "lower(path) LIKE '%/5%'", "r3": "len([x FOR x IN string_split(lower(coalesce(query, '')), '&') IF split_part(x, '=', 1) = 'ref']) > 0", "r4": query_list.format("page=2"), "r5": "path LIKE '%5'", "r6": "path LIKE '/de/%'"}
    rank = {"global": 0, "preset": 1, "site_profile": 2, "per_audit": 3}
    weight = {"exact_url": 6, "exact_path": 5, "query_parameter_equals": 4, "query_parameter_exists": 3, "path_contains": 1}
    layer = {"exclude_from_discovery": "discovery", "exclude_from_metadata_scoring": "metadata", "exclude_from_sitemap": "sitemap"}
    one = " UNION ALL ".join(f"SELECT page_id, '{i}' AS rule_id, '{a}' AS action, '{layer.get(a, 'review')}' AS layer, {rank[s]} AS sr, {weight.get(k, 2)} AS sp, {p} AS priority FROM parts WHERE {tests[i]}" for i, k, _, _, a, p, s, _ in GOVERNANCE)
    return f"""WITH {URL_PARTS}, hits AS ({one}), active AS (SELECT * FROM hits h WHERE NOT (rule_id = 'r3' AND EXISTS (SELECT 1 FROM hits o WHERE o.page_id = h.page_id AND o.rule_id = 'r4')))
      SELECT page_id AS url_id, layer, first(action ORDER BY sr DESC, sp DESC, priority DESC, rule_id) AS outcome, first(rule_id ORDER BY sr DESC, sp DESC, priority DESC, rule_id) AS primary_rule, count(*) AS contributing, count(DISTINCT action) > 1 AS conflict FROM active GROUP BY page_id, layer"""


@query(_governance_sql())
def governance_matches(spark: SparkSession, d: str) -> DataFrame:
    urls = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("url_id"), governed_url(F.col("url")).alias("g"))
    return governance.decisions(governance.matches(urls, GOVERNANCE))


def _facts_sql() -> str:
    """The facts of a URL, stated by hand."""
    return f"""WITH {duck_crawl()}, {_recommended_sql()}, facts0 AS (SELECT crawl.*, recommended.state AS recommendation, CASE WHEN http_status IS NULL THEN 'failed' ELSE 'fetched' END AS fetch_state, CASE WHEN parsed_as_html THEN 'parsed_html' ELSE 'not_html' END AS parse_state,
      CASE WHEN robots_allowed THEN 'allowed' ELSE 'blocked' END AS robots_state, CASE redirect_count WHEN 0 THEN 'not_redirected' ELSE 'redirected' END AS redirect_state,
      CASE WHEN canonical_page IS NULL THEN 'missing' WHEN canonical_page = page_id OR (redirect_count > 0 AND canonical_page = page_id - 1) THEN 'canonical' ELSE 'indeterminate' END AS canonical_state, CASE WHEN NOT robots_allowed THEN 'not_indexable' WHEN parsed_as_html THEN 'indexable' ELSE 'indeterminate' END AS indexability
      FROM crawl JOIN recommended USING (page_id)),
    facts AS (SELECT *, CASE WHEN evidence_state <> 'complete' THEN 'indeterminate' WHEN http_status >= 400 THEN 'broken' WHEN category <> 'html' THEN 'non_html' WHEN redirect_count > 0 THEN 'redirect_source' WHEN canonical_state <> 'canonical' THEN 'indeterminate'
      WHEN recommendation = 'include' THEN CASE WHEN in_sitemap THEN 'valid_unchanged' ELSE 'add' END WHEN recommendation = 'review' THEN 'review' WHEN in_sitemap THEN 'remove' WHEN robots_allowed THEN 'excluded_by_rule' ELSE 'not_crawlable' END AS sitemap_state FROM facts0)"""


#: The populations that each URL belongs to, stated by hand.
POPULATIONS_BY_HAND = """SELECT population, count(*) AS urls FROM (SELECT unnest(['discovered', 'enqueued'] || CASE WHEN http_status IS NULL THEN ['failed'] ELSE ['fetched'] || CASE WHEN parsed_as_html THEN [] ELSE ['resource'] END END || CASE WHEN parsed_as_html THEN ['parsed_html'] ELSE [] END
  || CASE indexability WHEN 'indexable' THEN ['indexable'] ELSE [] END || CASE canonical_state WHEN 'canonical' THEN ['canonical'] ELSE [] END || CASE WHEN parsed_as_html AND robots_allowed AND canonical_state = 'canonical' THEN ['metadata_scoring_eligible'] ELSE [] END
  || CASE recommendation WHEN 'include' THEN ['sitemap_eligible'] WHEN 'exclude' THEN ['excluded'] ELSE [] END || CASE evidence_state WHEN 'complete' THEN [] ELSE ['partial'] END || CASE WHEN 'indeterminate' IN (indexability, canonical_state) THEN ['indeterminate'] ELSE [] END) AS population FROM facts) GROUP BY population"""


@query(_facts_sql() + " SELECT page_id, " + ", ".join(combined.FACTS) + ", sitemap_state FROM facts")
def combined_url_facts(spark: SparkSession, d: str) -> DataFrame:
    crawl = Site(spark, d).crawl
    return combined.url_facts(crawl, sitemap.recommendations(crawl)).select("page_id", *combined.FACTS, "sitemap_state")


@query(_facts_sql() + " " + POPULATIONS_BY_HAND)
def populations(spark: SparkSession, d: str) -> DataFrame:
    crawl = Site(spark, d).crawl_once()
    return combined.populations(combined.url_facts(crawl, sitemap.recommendations(crawl)))


def _groups_sql() -> str:
    one = """SELECT page_id, t[1] AS code, t[2] AS module, t[3] AS severity, CAST(t[4] AS INTEGER) AS ip, CAST(t[5] AS INTEGER) AS sp FROM (SELECT page_id, unnest(list_filter([
      CASE WHEN parsed_as_html AND (n_titles = 0 OR title = '') THEN ['metadata_title_missing', 'metadata', 'high', '1', '1'] END, CASE WHEN parsed_as_html THEN ['metadata_description_missing', 'metadata', 'medium', '1', '1'] END, CASE WHEN parsed_as_html AND len(title) > 60 THEN ['long_title', 'metadata', 'medium', '1', '1'] END,
      CASE WHEN http_status >= 400 THEN ['status_error', 'status_and_redirects', 'high', '0', '0'] END, CASE WHEN NOT robots_allowed THEN ['robots_blocked', 'robots_and_indexability', 'high', '0', '0'] END, CASE WHEN parsed_as_html AND canonical_page IS NULL THEN ['canonical_missing', 'canonicals', 'medium', '1', '0'] END
    ], lambda x: x IS NOT NULL)) AS t FROM crawl)"""
    return f"""WITH {duck_crawl()}, found AS ({one}) SELECT code, module, severity, count(DISTINCT page_id) AS affected, min(page_id) AS first_page,
      printf('%06d|%06d|%06d|%06d|', list_position(['critical', 'high', 'medium', 'low'], severity) - 1, ip, sp, 100000 - least(count(DISTINCT page_id), 100000)) || code AS priority FROM found GROUP BY code, module, severity, ip, sp"""


@query(_groups_sql())
def issue_groups(spark: SparkSession, d: str) -> DataFrame:
    return combined.issue_groups(combined.findings(Site(spark, d).crawl))


@query(_groups_sql().split(" SELECT code, module")[0] + ", recommendation AS (" + (_facts_sql() + " SELECT page_id, recommendation FROM facts") + """)
  SELECT 'severity' AS dimension, severity AS value, count(DISTINCT page_id) AS urls FROM found GROUP BY severity UNION ALL SELECT 'module', module, count(DISTINCT page_id) FROM found GROUP BY module
  UNION ALL SELECT 'affected', 'all', count(DISTINCT page_id) FROM found UNION ALL SELECT 'recommendation', recommendation, count(DISTINCT page_id) FROM recommendation GROUP BY recommendation""")
def combined_summary(spark: SparkSession, d: str) -> DataFrame:
    own = Site(spark, d).crawl_once()
    facts = combined.url_facts(own, sitemap.recommendations(own))
    return combined.summary(facts, combined.findings(own)).where("dimension <> 'population'")


# -- images and structured data ---------------------------------------------------------------------------------------

IMAGES = """SELECT page_id, k AS "index", CASE page_id % 6 WHEN 0 THEN 'data:image/png;base64,AA' WHEN 1 THEN '/img/placeholder.png' ELSE concat('/img/', page_id % 25 + k, '.png') END AS src,
  CASE (page_id + k) % 11 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'Logo' WHEN 4 THEN 'IMG_2041' WHEN 5 THEN 'photo.jpg' WHEN 6 THEN 'www.example.com' WHEN 7 THEN repeat('long text ', 30) ELSE concat('A view of item ', page_id % 7) END AS alt,
  CASE (page_id + k) % 5 WHEN 0 THEN NULL WHEN 1 THEN '640' WHEN 2 THEN '0' WHEN 3 THEN 'wide' ELSE '320' END AS width, CASE (page_id + k) % 4 WHEN 0 THEN NULL WHEN 1 THEN '480' WHEN 2 THEN '-1' ELSE '200' END AS height,
  CASE page_id % 4 WHEN 0 THEN 'lazy' WHEN 1 THEN 'soon' WHEN 2 THEN 'eager' END AS loading, CASE WHEN page_id % 3 = 0 THEN 'async' END AS decoding, CASE WHEN page_id % 5 = 0 THEN 'high' END AS priority,
  page_id % 3 = 1 AS linked, page_id % 8 = 2 AS decorative, page_id % 13 <> 7 AS internal, CASE page_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN NULL ELSE 200 END AS resource_status FROM (SELECT page_id, 0 AS k FROM PAGES UNION ALL SELECT page_id, 1 FROM PAGES) x"""
NAME_TEST = "coalesce(regexp_full_match(alt, '(?i)(img[_-]?[0-9]+|dsc[0-9]+|photo[_-]?[0-9]+|image([_-][0-9]+)+|[A-Za-z0-9_-]+(final|copy|v[0-9]+)[A-Za-z0-9_-]*|[^/]+\\.(jpe?g|png|gif|webp|svg|avif))'), false) AS name_like"


def _images(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(IMAGES.replace('"index"', "`index`").replace("FROM PAGES", "FROM {pages}"), pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id"))


#: States of an image, and its severity, reason and action, stated by hand.
IMAGE_STATES_BY_HAND = """CASE WHEN alt IS NULL THEN 'missing' WHEN shown = '' THEN CASE WHEN alt <> '' THEN 'whitespace' WHEN linked THEN 'link_empty' WHEN decorative THEN 'decorative' ELSE 'empty' END WHEN len(shown) > 200 THEN 'overlong'
    WHEN list_contains(['image', 'photo', 'picture', 'graphic', 'icon', 'logo', 'banner', 'thumbnail', 'click here', 'read more', 'learn more'], lower(shown)) THEN 'generic' WHEN name_like THEN 'filename' WHEN url_like THEN 'url' ELSE 'present' END AS alt_state,
  CASE WHEN width IS NULL THEN CASE WHEN height IS NULL THEN 'both_missing' ELSE 'width_missing' END WHEN height IS NULL THEN 'height_missing' WHEN width_px IS NULL THEN 'invalid_width' WHEN height_px IS NULL THEN 'invalid_height' WHEN width_px * height_px = 0 THEN 'zero' WHEN least(width_px, height_px) < 0 THEN 'review' ELSE 'present' END AS dimension_state,
  CASE WHEN coalesce(trim(loading), '') <> '' THEN CASE lower(trim(loading)) WHEN 'lazy' THEN 'lazy' WHEN 'eager' THEN 'eager' ELSE 'invalid' END WHEN lower(trim(decoding)) = 'async' THEN 'decoding_async' WHEN lower(trim(priority)) = 'high' THEN 'fetchpriority_high' ELSE 'missing' END AS loading_state,
  CASE WHEN starts_with(src, 'data:') THEN 'data' WHEN contains(lower(src), 'placeholder') THEN 'placeholder' WHEN internal THEN CASE WHEN resource_status IS NULL THEN 'unverified' WHEN resource_status < 300 THEN 'working' WHEN resource_status < 400 THEN 'redirecting' ELSE 'broken' END ELSE 'external' END AS resource"""
IMAGE_OUTCOME_BY_HAND = """CASE resource WHEN 'broken' THEN [CASE WHEN reuse < 5 THEN 'high' ELSE 'critical' END, 'broken_internal_image', 'fix_url'] WHEN 'redirecting' THEN ['medium', 'redirecting_image_source', 'update_destination'] WHEN 'placeholder' THEN ['medium', 'placeholder_image', 'replace_placeholder'] WHEN 'external' THEN ['info', 'external_image_review', 'review']
    ELSE CASE WHEN alt_state = 'missing' OR alt_state = 'link_empty' THEN CASE WHEN linked THEN ['high', 'missing_alt_linked', 'add_alt'] WHEN reuse = 1 THEN ['medium', 'missing_alt', 'add_alt'] ELSE ['high', 'missing_alt', 'add_alt'] END WHEN alt_state IN ('generic', 'filename', 'url') THEN ['medium', alt_state, 'replace_alt']
      WHEN alt_state = 'empty' OR alt_state = 'whitespace' THEN ['low', 'empty_alt_review', 'confirm_decorative'] WHEN alt_state = 'overlong' THEN ['low', 'overlong_alt_review', 'replace_alt'] WHEN dimension_state <> 'present' THEN [CASE WHEN reuse < 5 THEN 'low' ELSE 'medium' END, 'missing_or_invalid_dimensions', 'add_dimensions']
      WHEN loading_state = 'missing' OR loading_state = 'invalid' THEN ['low', 'loading_attribute_review', 'review_loading'] ELSE ['info', 'valid_image_occurrence', 'no_action'] END END"""
DUCK_IMAGES = f"""WITH im AS ({IMAGES.replace("FROM PAGES", "FROM pages")}), reused AS (SELECT im.*, r.reuse, trim(regexp_replace(alt, '\\s+', ' ', 'g')) AS shown, {NAME_TEST}, coalesce(regexp_matches(alt, '(?i)^(https?://|www\\.|/)'), false) AS url_like, TRY_CAST(trim(width) AS INTEGER) AS width_px, TRY_CAST(trim(height) AS INTEGER) AS height_px
  FROM im JOIN (SELECT src, count(DISTINCT page_id) AS reuse FROM im GROUP BY src) r USING (src)), s1 AS (SELECT *, {IMAGE_STATES_BY_HAND} FROM reused),
  s2 AS (SELECT *, {IMAGE_OUTCOME_BY_HAND} AS o FROM s1), s3 AS (SELECT *, o[1] AS severity, o[2] AS reason, o[3] AS action FROM s2)"""


@query(f"{DUCK_IMAGES} SELECT page_id, index, src, alt_state, dimension_state, loading_state, resource, reuse, severity, reason, action FROM s3")
def image_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return images.occurrences(_images(spark, d))


@query(f"""WITH im AS ({IMAGES.replace("FROM PAGES", "FROM pages")}), shown AS (SELECT lower(trim(alt)) AS alt, src FROM im WHERE alt IS NOT NULL AND trim(alt) <> '')
  SELECT 'same_alt_many_images' AS kind, alt AS value, count(DISTINCT src) AS distinct_count, count(*) AS occurrences FROM shown GROUP BY alt HAVING count(DISTINCT src) > 1
  UNION ALL SELECT 'same_image_many_alts', src, count(DISTINCT alt), count(*) FROM shown GROUP BY src HAVING count(DISTINCT alt) > 1""")
def image_duplicate_alts(spark: SparkSession, d: str) -> DataFrame:
    return images.duplicate_groups(_images(spark, d))


@query(f"""{DUCK_IMAGES} SELECT page_id, count(*) AS images, count(*) FILTER (WHERE alt_state = 'missing') AS missing_alts, count(*) FILTER (WHERE resource = 'broken') AS broken, count(*) FILTER (WHERE dimension_state <> 'present') AS unsized FROM s3 GROUP BY page_id""")
def image_page_summaries(spark: SparkSession, d: str) -> DataFrame:
    return images.page_summaries(images.occurrences(_images(spark, d)))


BLOCK_HTML = """concat('<html><script type="application/ld+json">{"@type":"', CASE page_id % 4 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Article' WHEN 2 THEN 'Product' ELSE 'Thing' END, '","@id":"e', page_id % 9, '","name":"N', page_id % 5, '"', CASE WHEN page_id % 10 = 3 THEN '' ELSE '}' END, '</script></html>')"""
BLOCKS = """b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Article' WHEN 2 THEN 'Product' ELSE 'Thing' END AS type, concat('e', page_id % 9) AS identifier, page_id % 5 AS n, page_id % 10 = 3 AS bad FROM pages)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url", F.expr(BLOCK_HTML).alias("html"))
    return html.blocks(html.parsed(own))


@query(f"WITH {BLOCKS} SELECT identifier, count(DISTINCT page_id) AS pages, count(*) AS occurrences, count(DISTINCT type || n) AS variants, count(DISTINCT type) AS type_sets FROM b WHERE NOT bad GROUP BY identifier")
def structured_consistency(spark: SparkSession, d: str) -> DataFrame:
    return structured.entity_consistency(_blocks(spark, d))


@query(f"""WITH {BLOCKS}, f AS (SELECT page_id, 'json_ld_invalid_json' AS code FROM b WHERE bad UNION ALL SELECT page_id, 'json_ld_missing_context' FROM b)
  SELECT page_id, 0 AS index, CAST(NULL AS INTEGER) AS entity, code, CAST(NULL AS VARCHAR) AS subject FROM f""")
def structured_block_findings(spark: SparkSession, d: str) -> DataFrame:
    return structured.block_findings(_blocks(spark, d))


STRUCTURED = """SELECT page_id, k AS nr, CASE (page_id + k) % 5 WHEN 3 THEN 'microdata' WHEN 4 THEN 'rdfa' ELSE 'json_ld' END AS format,
  CASE page_id % 7 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Article' WHEN 2 THEN 'Product' WHEN 3 THEN 'Offer' WHEN 5 THEN 'LocalBusiness' WHEN 6 THEN '@odd' END AS type1,
  CASE WHEN page_id % 14 = 1 THEN 'BlogPosting' WHEN page_id % 14 = 2 THEN 'Gadget' END AS type2, CASE WHEN page_id % 4 <> 0 THEN concat('#e', page_id % 40 + k) END AS id,
  CASE page_id % 5 WHEN 1 THEN '' WHEN 2 THEN ' ' WHEN 3 THEN concat('N', page_id % 6) WHEN 4 THEN 'N1' END AS name1, CASE WHEN page_id % 8 = 3 THEN concat('N', page_id % 3) END AS name2,
  CASE page_id % 6 WHEN 0 THEN 'https://x.test/' WHEN 1 THEN 'ftp://x.test/' WHEN 2 THEN '/rel' WHEN 3 THEN '[structured]' WHEN 4 THEN 'HTTP://y.test' END AS url,
  CASE page_id % 3 WHEN 0 THEN '3.5' WHEN 1 THEN 'free' END AS price, CASE WHEN page_id % 17 = 5 THEN 'invalid_json' END AS error, CASE page_id % 19 WHEN 4 THEN 'empty' WHEN 6 THEN 'scalar' ELSE 'object' END AS root,
  page_id % 23 = 1 AS truncated, CASE page_id % 4 WHEN 0 THEN 'https://schema.org' WHEN 1 THEN 'http://Schema.org/' WHEN 2 THEN 'http://other.test' END AS context,
  CASE page_id % 3 WHEN 0 THEN 'application/ld+json' WHEN 1 THEN ' Application/LD+JSON ; charset=utf-8' WHEN 2 THEN 'application/json+ld' END AS script_type,
  CASE page_id % 13 WHEN 1 THEN 'microdata_unresolved_itemref:x' WHEN 2 THEN 'microdata_property_outside_scope' WHEN 3 THEN 'microdata_invalid_itemid' WHEN 4 THEN 'rdfa_invalid_prefix_mapping' WHEN 5 THEN 'rdfa_unsupported_pattern' WHEN 6 THEN 'property_missing_value:name' END AS told,
  CASE page_id % 9 WHEN 1 THEN '#e1' WHEN 2 THEN '#far' END AS named, concat('f', page_id % 900 + k) AS fingerprint,
  CASE WHEN page_id % 29 = 3 THEN 404 ELSE 200 END AS http_status, CASE WHEN page_id % 31 = 2 THEN 'application/pdf' WHEN page_id % 31 > 3 THEN 'Text/HTML; charset=x' END AS content_type, CASE WHEN page_id % 37 = 1 THEN 'non_indexable' ELSE 'indexable' END AS indexability_state
  FROM (SELECT page_id, 0 AS k FROM PAGES UNION ALL SELECT page_id, 1 FROM PAGES WHERE page_id % 2 = 0) x"""


def _structured(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    flat = spark.sql(STRUCTURED.replace("FROM PAGES", "FROM {pages}"), pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id"))
    held = lambda *c: F.array_compact(F.array(*c))
    values = F.create_map(F.lit("name"), held("name1", "name2"), F.lit("url"), held("url"), F.lit("price"), held("price"))
    blocks = flat.select(
        "page_id", F.col("nr").alias("index"), "format", held("type1", "type2").alias("types"), held("id").alias("ids"), F.map_filter(values, lambda _, v: F.size(v) > 0).alias("properties"), "error", "root", "truncated",
        held("context").alias("contexts"), "script_type", held("told").alias("diagnostics"), held("named").alias("references"), "fingerprint",
    )
    return blocks, flat.where("nr = 0").select("page_id", "http_status", "content_type", "indexability_state")


DUCK_STRUCTURED = f"""WITH s AS ({STRUCTURED.replace("FROM PAGES", "FROM pages")}), b AS (SELECT *, CASE WHEN name1 IS NULL AND name2 IS NULL THEN [] WHEN name2 IS NULL THEN [name1] WHEN name1 IS NULL THEN [name2] ELSE [name1, name2] END AS names FROM s),
  e AS (SELECT *, 0 AS entity, type1 AS type FROM b UNION ALL SELECT *, 1, type2 FROM b WHERE type2 IS NOT NULL),
  p AS (SELECT page_id, nr, entity, told, 'name' AS property, names AS vs FROM e WHERE len(names) > 0 UNION ALL SELECT page_id, nr, entity, told, 'url', [url] FROM e WHERE url IS NOT NULL UNION ALL SELECT page_id, nr, entity, told, 'price', [price] FROM e WHERE price IS NOT NULL),
  bf(page_id, nr, code) AS (SELECT page_id, nr, 'json_ld_invalid_json' FROM b WHERE error = 'invalid_json' UNION ALL SELECT page_id, nr, 'json_ld_scalar_root' FROM b WHERE page_id % 19 = 6 UNION ALL SELECT page_id, nr, 'json_ld_empty_block' FROM b WHERE page_id % 19 = 4
    UNION ALL SELECT page_id, nr, 'json_ld_truncated' FROM b WHERE page_id % 23 = 1 UNION ALL SELECT page_id, nr, 'json_ld_missing_context' FROM b WHERE format = 'json_ld' AND page_id % 4 = 3 UNION ALL SELECT page_id, nr, 'json_ld_unrecognized_context' FROM b WHERE format = 'json_ld' AND page_id % 4 = 2
    UNION ALL SELECT page_id, nr, 'json_ld_unsupported_script_type' FROM b WHERE format = 'json_ld' AND page_id % 3 = 2 UNION ALL SELECT page_id, nr, 'json_ld_missing_type' FROM b WHERE format = 'json_ld' AND page_id % 7 = 4 AND page_id % 17 <> 5
    UNION ALL SELECT page_id, nr, 'microdata_missing_itemtype' FROM b WHERE format = 'microdata' AND page_id % 7 = 4 UNION ALL SELECT page_id, nr, 'microdata_empty_itemscope' FROM b WHERE format = 'microdata' AND len(names) = 0 AND url IS NULL AND price IS NULL
    UNION ALL SELECT page_id, nr, 'microdata_unresolved_itemref' FROM b WHERE format = 'microdata' AND page_id % 13 = 1 UNION ALL SELECT page_id, nr, told FROM b WHERE page_id % 13 BETWEEN 2 AND 5
    UNION ALL SELECT page_id, nr, 'rdfa_missing_vocabulary_context' FROM b WHERE format = 'rdfa' AND page_id % 4 = 3 UNION ALL SELECT page_id, nr, 'rdfa_property_without_subject' FROM b WHERE format = 'rdfa' AND page_id % 4 = 0 AND (len(names) > 0 OR url IS NOT NULL OR price IS NOT NULL)
    UNION ALL SELECT page_id, nr, 'page_structured_data_on_error_status' FROM b WHERE page_id % 29 = 3 UNION ALL SELECT page_id, nr, 'page_structured_data_on_non_html_content' FROM b WHERE page_id % 31 = 2 UNION ALL SELECT page_id, nr, 'page_structured_data_on_nonindexable_page' FROM b WHERE page_id % 37 = 1),
  ef(page_id, nr, entity, code, subject) AS (SELECT page_id, nr, entity, 'entity_missing_identifier', NULL FROM e WHERE id IS NULL UNION ALL SELECT page_id, nr, entity, 'json_ld_invalid_type', NULL FROM e WHERE type = '@odd'
    UNION ALL SELECT page_id, nr, entity, 'property_empty_value', property FROM p WHERE property = 'name' AND trim(array_to_string(vs, '')) = '' UNION ALL SELECT page_id, nr, entity, 'property_missing_value', property FROM p WHERE property = 'name' AND page_id % 13 = 6
    UNION ALL SELECT page_id, nr, entity, 'property_duplicate_value', property FROM p WHERE len(vs) = 2 AND vs[1] = vs[2] UNION ALL SELECT page_id, nr, entity, 'property_url_invalid', 'url' FROM e WHERE page_id % 6 IN (1, 2) UNION ALL SELECT page_id, nr, entity, 'property_reference_unresolved', named FROM e WHERE named IS NOT NULL AND named IS DISTINCT FROM id),
  groups AS (SELECT fingerprint, min(page_id) AS page_id, bool_or(format = 'json_ld') AS json FROM b GROUP BY fingerprint HAVING count(*) > 1), pages_of AS (SELECT id, page_id, count(*) AS n FROM e WHERE id IS NOT NULL GROUP BY id, page_id),
  used AS (SELECT id, arg_min([page_id, nr, entity], [page_id, nr, entity]) AS spot, count(DISTINCT concat(CAST(names AS VARCHAR), '|', url, '|', price)) AS variants, count(DISTINCT page_id) AS page_count, count(DISTINCT type) AS type_count, bool_and(type IN ('Article', 'BlogPosting', 'NewsArticle')) AS articles FROM e WHERE id IS NOT NULL GROUP BY id),
  cf(page_id, nr, entity, code, subject) AS (SELECT page_id, NULL, NULL, CASE WHEN json THEN 'json_ld_duplicate_block' ELSE 'entity_duplicate_on_page' END, fingerprint FROM groups
    UNION ALL SELECT spot[1], spot[2], spot[3], 'json_ld_duplicate_entity_id', id FROM used WHERE id IN (SELECT id FROM pages_of WHERE n > 1) UNION ALL SELECT spot[1], spot[2], spot[3], 'entity_inconsistent_across_pages', id FROM used WHERE variants > 1 AND page_count > 1
    UNION ALL SELECT spot[1], spot[2], spot[3], 'entity_conflicting_types', id FROM used WHERE type_count > 1 AND NOT articles UNION ALL SELECT page_id, NULL, NULL, 'page_multiple_primary_entities', NULL FROM e GROUP BY page_id HAVING count(*) > 1
    UNION ALL SELECT NULL, NULL, NULL, 'sitewide_schema_inconsistency', NULL FROM (SELECT count(DISTINCT page_id) AS n, count(DISTINCT concat(type1, '|', type2)) AS kinds FROM b) WHERE n >= 3 AND kinds > 1),
  f AS (SELECT page_id, nr, NULL AS entity, code, NULL AS subject FROM bf UNION ALL SELECT * FROM ef UNION ALL SELECT * FROM cf),
  wanted(type, property) AS (VALUES ('Organization', 'name'), ('Organization', 'url'), ('LocalBusiness', 'name'), ('LocalBusiness', 'address'), ('Article', 'headline'), ('Article', 'author'), ('Article', 'publisher'), ('Article', 'datePublished'),
    ('BlogPosting', 'headline'), ('BlogPosting', 'author'), ('BlogPosting', 'publisher'), ('BlogPosting', 'datePublished'), ('Product', 'name'), ('Product', 'offers'), ('Offer', 'price'), ('Offer', 'priceCurrency')),
  o AS (SELECT page_id, nr, entity, type AS profile, property, CASE WHEN property = 'name' AND len(names) > 0 THEN CASE WHEN trim(array_to_string(names, '')) = '' THEN 'empty' WHEN len(names) = 2 AND trim(names[1]) <> '' AND names[1] <> names[2] THEN 'conflicting' ELSE 'present' END
    WHEN property = 'url' AND url IS NOT NULL THEN CASE page_id % 6 WHEN 1 THEN 'invalid' WHEN 2 THEN 'invalid' WHEN 3 THEN 'indeterminate' ELSE 'present' END WHEN property = 'price' AND price IS NOT NULL THEN CASE price WHEN 'free' THEN 'invalid' ELSE 'present' END ELSE 'missing' END AS state FROM e JOIN wanted USING (type))"""
INFO_CODES = "('json_ld_unrecognized_context', 'rdfa_property_without_subject', 'rdfa_unsupported_pattern', 'entity_missing_identifier', 'property_duplicate_value', 'page_multiple_primary_entities')"


@query(f"{DUCK_STRUCTURED} SELECT page_id, nr AS index, entity, code, subject, CASE WHEN code IN {INFO_CODES} THEN 'info' ELSE 'warning' END AS severity FROM f")
def structured_findings(spark: SparkSession, d: str) -> DataFrame:
    return structured.findings(*_structured(spark, d)).select("page_id", "index", "entity", "code", "subject", "severity")


@query(f"{DUCK_STRUCTURED} SELECT page_id, nr AS index, entity, profile, property, state FROM o")
def structured_entities(spark: SparkSession, d: str) -> DataFrame:
    return structured.profile_observations(_structured(spark, d)[0])


KNOWN_ACTIONS = ", ".join(f"('{code}', '{action}')" for code, action in structured.ACTIONS)


@query(f"""{DUCK_STRUCTURED}, acts(code, action) AS (VALUES {KNOWN_ACTIONS}), gaps AS (SELECT * FROM o WHERE state <> 'present')
  SELECT DISTINCT page_id, nr AS index, entity, action, code AS reason, CASE WHEN code = 'sitewide_schema_inconsistency' THEN 'site' ELSE 'page' END AS scope, 'medium' AS priority FROM f JOIN acts USING (code)
  UNION ALL SELECT page_id, nr, entity, 'add_missing_required_profile_property', concat(profile, '.', property), 'entity', 'medium' FROM gaps WHERE state <> 'indeterminate'
  UNION ALL SELECT page_id, nr, entity, 'review_article_publisher', concat(profile, '.publisher'), 'entity', 'medium' FROM gaps WHERE property = 'publisher'
  UNION ALL SELECT page_id, nr, entity, 'review_product_offer_relationship', concat(profile, '.', property), 'entity', 'medium' FROM gaps WHERE property IN ('offers', 'price', 'priceCurrency')
  UNION ALL SELECT page_id, NULL, NULL, 'review_schema_format_mix', 'formats', 'page', 'low' FROM b GROUP BY page_id HAVING count(DISTINCT format) > 1
  UNION ALL SELECT page_id, nr, entity, 'review_local_business_subtype', type, 'entity', 'low' FROM e WHERE type = 'LocalBusiness' UNION ALL SELECT page_id, nr, entity, 'review_unknown_type', type, 'entity', 'low' FROM e WHERE type = 'Gadget'
  UNION ALL SELECT page_id, nr, entity, 'review_organization_identity', type, 'entity', 'medium' FROM e WHERE type = 'Organization' AND id IS NULL
  UNION ALL SELECT page_id, nr, entity, 'review_organization_identity', f.code, 'site', 'medium' FROM f JOIN e USING (page_id, nr, entity) WHERE f.code = 'entity_inconsistent_across_pages' AND type = 'Organization'""")
def structured_recommendations(spark: SparkSession, d: str) -> DataFrame:
    blocks, facts = _structured(spark, d)
    return structured.recommendations(blocks, structured.findings(blocks, facts)).drop("confidence").distinct()


# -- migration --------------------------------------------------------------------------------------------------------

OLD, NEW = "https://old.example", "https://new.example"
MIGRATION = {
    "sources": f"SELECT concat('{OLD}/p/', page_id) AS source_url, CASE WHEN page_id % 12 = 5 THEN concat('{NEW}/proposed/', page_id) END AS proposed FROM PAGES",
    "planned": f"SELECT concat('{OLD}/p/', page_id) AS source_url, concat('{NEW}/p/', CASE WHEN page_id % 15 = 0 THEN 1 ELSE page_id END) AS destination_url, 301 AS expected_status FROM PAGES WHERE page_id % 3 = 0 UNION ALL SELECT concat('{OLD}/p/', page_id), concat('{NEW}/other/', page_id), 301 FROM PAGES WHERE page_id % 30 = 0",
    "old_pages": f"SELECT page_id, concat('{OLD}/p/', page_id) AS url, CASE WHEN page_id % 8 = 2 THEN concat('{OLD}/moved/', page_id) END AS final_url, CASE WHEN page_id % 9 = 4 THEN concat('{NEW}/p/', page_id + 1) END AS canonical_url, concat('Title of page ', page_id) AS title, CASE WHEN page_id % 4 <> 1 THEN concat('About page ', page_id) END AS description, 200 AS http_status, 0 AS redirect_count, false AS redirect_loop, 'html' AS category, 'en' AS language, true AS robots_allowed, page_id % 13 <> 4 AS indexable FROM PAGES WHERE page_id % 21 <> 2",
    "new_pages": f"SELECT page_id, CASE WHEN page_id % 3 = 0 AND page_id % 4 <> 0 THEN concat('{OLD}/p/', page_id) ELSE concat('{NEW}/p/', page_id) END AS url, CASE WHEN page_id % 3 = 0 THEN concat('{NEW}/p/', page_id) END AS final_url, CASE WHEN page_id % 14 IN (3, 10) THEN NULL WHEN page_id % 20 = 9 THEN concat('{OLD}/p/', page_id) ELSE concat('{NEW}/p/', page_id) END AS canonical_url, CASE WHEN page_id % 6 = 1 THEN NULL WHEN page_id % 7 = 1 THEN concat('zqx', page_id) ELSE concat('Title of page ', page_id) END AS title, CASE WHEN page_id % 9 = 2 THEN '' WHEN page_id % 10 = 3 THEN 'zqx' WHEN page_id % 11 <> 5 THEN concat('About page ', page_id) END AS description, CASE WHEN page_id % 16 = 10 THEN 404 WHEN page_id % 19 = 6 THEN 500 WHEN page_id % 27 = 3 THEN 302 ELSE 200 END AS http_status, CASE WHEN page_id % 18 = 3 THEN 2 ELSE 0 END AS redirect_count, page_id % 55 = 6 AS redirect_loop, CASE WHEN page_id % 17 = 3 THEN 'pdf' ELSE 'html' END AS category, CASE WHEN page_id % 14 = 5 THEN 'de' ELSE 'en' END AS language, page_id % 23 <> 7 AS robots_allowed, page_id % 12 <> 7 AS indexable FROM PAGES WHERE page_id % 11 <> 8",
}
DUCK_MIGRATION = ", ".join(f"{k} AS ({v.replace('FROM PAGES', 'FROM pages')})" for k, v in MIGRATION.items())
PATH = "regexp_extract({}, '^[a-z]+://[^/]+(/[^?#]*)', 1)"
MAPPED = f"""new_urls AS (SELECT DISTINCT u AS dest FROM (SELECT unnest([url, final_url]) AS u FROM new_pages) WHERE u IS NOT NULL), paths AS (SELECT {PATH.format("dest")} AS path, min(dest) AS dest FROM new_urls GROUP BY 1 HAVING count(*) = 1),
  old AS (SELECT s.source_url, o.* FROM sources s JOIN old_pages o ON o.url = s.source_url), signature AS (SELECT lower(title) AS t, lower(description) AS s, category, canonical_url, indexable, min(coalesce(final_url, url)) AS dest FROM new_pages GROUP BY ALL HAVING count(DISTINCT coalesce(final_url, url)) = 1),
  candidates AS (SELECT source_url, destination_url AS dest, 0 AS place FROM planned UNION SELECT source_url, proposed, 1 FROM sources WHERE proposed IS NOT NULL UNION SELECT source_url, final_url, 2 FROM old WHERE final_url <> source_url
    UNION SELECT source_url, source_url, 3 FROM sources JOIN new_urls ON dest = source_url UNION SELECT source_url, '{NEW}' || substring(source_url, {len(OLD) + 1}), 4 FROM sources UNION SELECT source_url, dest, 5 FROM sources JOIN paths ON path = {PATH.format("source_url")}
    UNION SELECT source_url, canonical_url, 6 FROM old JOIN new_urls ON dest = canonical_url UNION SELECT source_url, dest, 7 FROM old o JOIN signature n ON lower(o.title) IS NOT DISTINCT FROM n.t AND lower(o.description) IS NOT DISTINCT FROM n.s AND o.category IS NOT DISTINCT FROM n.category AND o.canonical_url IS NOT DISTINCT FROM n.canonical_url AND o.indexable IS NOT DISTINCT FROM n.indexable),
  best AS (SELECT source_url, first(place ORDER BY place, dest) AS place, first(dest ORDER BY place, dest) AS dest, count(DISTINCT dest) AS competing, count(*) FILTER (WHERE place = 0) AS explicit FROM candidates GROUP BY source_url),
  chosen AS (SELECT source_url, place, dest, explicit > 1 OR (competing > 1 AND place >= 3) AS torn, coalesce(explicit > 1, false) AS split FROM sources LEFT JOIN best USING (source_url)),
  mapped0 AS (SELECT source_url, CASE WHEN NOT torn THEN dest END AS destination_url, CASE WHEN place IS NULL THEN 'unmapped' WHEN torn THEN 'manual_review_candidate' ELSE ['explicit_redirect_map', 'explicit_proposed_destination', 'observed_redirect', 'exact_normalized_url', 'configured_origin_substitution', 'path_match', 'canonical_hint', 'content_similarity_hint'][place + 1] END AS method,
    CASE WHEN place IS NULL THEN 'indeterminate' WHEN torn THEN 'low' WHEN place <= 3 THEN 'high' WHEN place = 4 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN place IS NULL THEN 'unmapped' WHEN torn THEN 'ambiguous' ELSE 'mapped' END AS state, split FROM chosen),
  mapped AS (SELECT source_url, destination_url, method, confidence, state, CASE WHEN split THEN 'one_to_many' WHEN state IN ('ambiguous', 'unmapped') THEN state WHEN n > 1 THEN 'many_to_one' ELSE 'one_to_one' END AS cardinality
    FROM mapped0 LEFT JOIN (SELECT destination_url, count(*) AS n FROM mapped0 WHERE destination_url IS NOT NULL GROUP BY destination_url) USING (destination_url))"""
#: A mapping's findings as code:category:severity:action:confidence, stated by hand: redirect, destination, what the old page had, canonical, indexability.
MIGRATION_BY_HAND = """[
    CASE WHEN planned AND NOT observed THEN 'redirect_missing:redirect:warning:add_missing_redirect:high' END, CASE WHEN observed AND observed_final IS NOT NULL AND observed_final <> destination_url THEN 'redirect_wrong_destination:redirect:warning:correct_redirect_destination:high' END,
    CASE WHEN observed_status = 302 OR observed_status = 307 THEN 'redirect_temporary:redirect:warning:replace_temporary_redirect:high' END, CASE WHEN planned AND observed AND observed_status <> 301 THEN 'redirect_status_mismatch:redirect:warning:correct_redirect_destination:high' END,
    CASE WHEN observed_loop THEN 'redirect_loop:redirect:error:resolve_redirect_loop:high' END, CASE WHEN observed_hops >= 2 THEN 'redirect_chain:redirect:warning:shorten_redirect_chain:high' END, CASE WHEN page_status >= 400 THEN 'redirect_to_error:redirect:error:fix_redirect_to_error:high' END,
    CASE WHEN page_known AND NOT page_indexable THEN 'redirect_to_nonindexable:redirect:warning:remove_destination_noindex:high' END, CASE WHEN NOT starts_with(destination_url, '{NEW}') AND NOT starts_with(destination_url, '{OLD}') THEN 'redirect_to_external:redirect:warning:correct_redirect_destination:high' END,
    CASE WHEN starts_with(destination_url, '{OLD}/') THEN 'redirect_to_out_of_scope:redirect:warning:correct_redirect_destination:high' END, CASE WHEN contains(source_url, '?') AND NOT contains(destination_url, '?') THEN 'redirect_query_dropped:redirect:warning:review_query_string_policy:high' END,
    CASE cardinality WHEN 'many_to_one' THEN 'redirect_many_to_one_review:redirect:warning:review_many_to_one_mapping:medium' END, CASE cardinality WHEN 'many_to_one' THEN 'redirect_destination_collision:redirect:warning:resolve_mapping_conflict:medium' END,
    CASE cardinality WHEN 'many_to_one' THEN 'content_consolidated:content:warning:review_many_to_one_mapping:medium' END,
    CASE WHEN NOT page_known THEN 'destination_missing:destination:warning:restore_missing_destination_page:high' END, CASE WHEN NOT page_known THEN 'content_missing:content:error:restore_missing_destination_page:high' END, CASE WHEN page_known AND page_status IS NULL THEN 'destination_status_unknown:destination:warning:fix_destination_error:indeterminate' END,
    CASE WHEN page_status = 404 THEN 'destination_404:destination:error:restore_missing_destination_page:high' WHEN page_status = 410 THEN 'destination_410:destination:error:restore_missing_destination_page:high' WHEN page_status >= 500 THEN 'destination_5xx:destination:error:fix_destination_error:high'
      WHEN page_status >= 400 THEN 'destination_other_4xx:destination:warning:fix_destination_error:high' WHEN page_status >= 300 OR page_hops > 0 THEN 'destination_redirecting:destination:warning:correct_redirect_destination:high' END,
    CASE WHEN page_category <> 'html' THEN 'destination_non_html:destination:warning:fix_destination_error:high' END, CASE WHEN page_known AND NOT page_indexable THEN 'destination_noindex:destination:warning:remove_destination_noindex:high' END, CASE WHEN NOT page_robots THEN 'destination_blocked_by_robots:destination:warning:review_robots_block:high' END,
    CASE WHEN page_known THEN CASE WHEN page_canonical IS NULL THEN 'destination_canonical_missing:destination:warning:correct_destination_canonical:high' WHEN page_canonical <> destination_url THEN 'destination_canonical_elsewhere:destination:warning:correct_destination_canonical:high' END END,
    CASE WHEN page_known AND NOT old_known THEN 'source_metadata_unavailable:metadata:warning:review_content_continuity:indeterminate' END, CASE WHEN page_known AND NOT old_known THEN 'content_similarity_indeterminate:content:warning:review_content_continuity:indeterminate' END,
    CASE WHEN page_known AND old_known AND page_title IS NULL THEN 'title_missing_after_migration:metadata:warning:restore_missing_metadata:high' WHEN title_changed THEN 'title_materially_changed:metadata:warning:review_material_metadata_change:medium' END,
    CASE WHEN page_known AND old_known AND NOT canonical_same THEN 'canonical_target_changed:metadata:warning:review_canonical_conflict:medium' END,
    CASE WHEN page_known AND old_description IS NOT NULL AND (page_description IS NULL OR page_description = '') THEN 'meta_description_missing_after_migration:metadata:warning:restore_missing_metadata:high' WHEN description_changed THEN 'meta_description_materially_changed:metadata:warning:review_material_metadata_change:medium' END,
    CASE WHEN page_known AND old_known AND page_category <> 'html' THEN 'content_type_changed:metadata:warning:review_content_continuity:high' END, CASE WHEN page_known AND old_known AND page_language <> 'en' THEN 'language_changed:metadata:warning:review_material_metadata_change:medium' END,
    CASE WHEN page_known AND old_indexable AND NOT page_indexable THEN 'indexability_regression:metadata:warning:review_indexability_regression:high' END, CASE WHEN page_known AND old_indexable AND NOT page_indexable THEN 'destination_noindex_regression:indexability:warning:review_indexability_regression:high' END,
    CASE WHEN starts_with(page_canonical, '{OLD}') THEN 'canonical_points_to_legacy_url:canonical:warning:review_canonical_conflict:high' END, CASE WHEN NOT starts_with(page_canonical, '{NEW}/') THEN 'canonical_points_to_wrong_host:canonical:warning:correct_destination_canonical:high' END,
    CASE WHEN c_hops > 0 THEN 'canonical_points_to_redirect:canonical:warning:correct_destination_canonical:high' END, CASE WHEN c_status >= 400 THEN 'canonical_points_to_error:canonical:error:correct_destination_canonical:high' END,
    CASE WHEN page_known AND old_canonical = source_url AND page_canonical IS DISTINCT FROM destination_url THEN 'canonical_self_reference_regression:canonical:warning:review_canonical_conflict:medium' END,
    CASE WHEN page_canonical <> destination_url THEN 'canonical_conflicts_with_redirect:canonical:warning:review_canonical_conflict:high' END, CASE WHEN page_canonical <> destination_url THEN 'canonical_regression:metadata:warning:review_canonical_conflict:high' END,
    CASE WHEN old_known AND old_robots AND NOT page_robots THEN 'destination_robots_block_regression:indexability:warning:review_robots_block:high' END, CASE WHEN observed_indexable THEN 'legacy_url_still_indexable:indexability:warning:review_indexability_regression:high' END,
    CASE WHEN observed_indexable AND page_known AND page_indexable THEN 'duplicate_source_and_destination_indexable:indexability:warning:review_indexability_regression:high' END
  ]""".replace("{OLD}", OLD).replace("{NEW}", NEW)
MIGRATION_FINDINGS = f"""once AS (SELECT source_url, min(expected_status) AS expected_status, true AS planned_ FROM planned GROUP BY source_url HAVING count(*) = 1),
  keyed AS (SELECT DISTINCT ON (key) * FROM (SELECT *, unnest(list_distinct([x FOR x IN [url, final_url] IF x IS NOT NULL])) AS key FROM new_pages) ORDER BY key, page_id DESC),
  joined AS (SELECT m.source_url, m.destination_url, m.cardinality, o.expected_status, coalesce(planned_, false) AS planned, s.key IS NOT NULL AS observed, s.final_url AS observed_final, s.http_status AS observed_status, s.redirect_count AS observed_hops, s.redirect_loop AS observed_loop,
    s.indexable AS observed_indexable, p.key IS NOT NULL AS page_known, p.http_status AS page_status, p.title AS page_title, p.description AS page_description, p.canonical_url AS page_canonical, p.category AS page_category, p.language AS page_language, p.robots_allowed AS page_robots, p.indexable AS page_indexable,
    p.redirect_count AS page_hops, b.url IS NOT NULL AS old_known, b.title AS old_title, b.description AS old_description, b.canonical_url AS old_canonical, b.category AS old_category, b.language AS old_language, b.robots_allowed AS old_robots, b.indexable AS old_indexable, c.http_status AS c_status, c.redirect_count AS c_hops,
    '{OLD}' AS source_origin, '{NEW}' AS destination_origin, regexp_extract(m.destination_url, '^([a-z]+://[^/?#]+)', 1) AS target_origin, regexp_extract(p.canonical_url, '^([a-z]+://[^/?#]+)', 1) AS canonical_origin, b.canonical_url IS NOT DISTINCT FROM p.canonical_url AS canonical_same,
    coalesce(b.title LIKE 'Title%' AND p.title LIKE 'zqx%', false) AS title_changed, coalesce(b.description LIKE 'About%' AND p.description = 'zqx', false) AS description_changed
    FROM mapped m LEFT JOIN once o USING (source_url) LEFT JOIN keyed s ON s.key = m.source_url LEFT JOIN keyed p ON p.key = m.destination_url LEFT JOIN old_pages b ON b.url = m.source_url LEFT JOIN keyed c ON c.key = p.canonical_url WHERE m.destination_url IS NOT NULL),
  findings AS (SELECT source_url, destination_url, split_part(t, ':', 1) AS code, split_part(t, ':', 2) AS category, split_part(t, ':', 3) AS severity, split_part(t, ':', 4) AS action, split_part(t, ':', 5) AS confidence FROM (SELECT source_url, destination_url, unnest(list_filter({MIGRATION_BY_HAND}, lambda x: x IS NOT NULL)) AS t FROM joined))"""


def _migration(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id")
    own = {k: spark.sql(v.replace("FROM PAGES", "FROM {pages}"), pages=pages) for k, v in MIGRATION.items()}
    own["mapped"] = migration.mappings(own["sources"], own["planned"], own["old_pages"], own["new_pages"], OLD, NEW)
    return own


def _migration_findings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    own = _migration(spark, d)
    return migration.findings(own["mapped"], own["planned"], own["old_pages"], own["new_pages"], OLD, NEW), own["mapped"]


@query(f"WITH {DUCK_MIGRATION}, {MAPPED} SELECT * FROM mapped")
def migration_mappings(spark: SparkSession, d: str) -> DataFrame:
    return _migration(spark, d)["mapped"]


@query(f"WITH {DUCK_MIGRATION}, {MAPPED}, {MIGRATION_FINDINGS} SELECT * FROM findings")
def migration_findings(spark: SparkSession, d: str) -> DataFrame:
    return _migration_findings(spark, d)[0]


@query(f"""WITH {DUCK_MIGRATION}, {MAPPED}, {MIGRATION_FINDINGS} SELECT action, destination_url, count(DISTINCT source_url) AS sources, arg_max(severity, list_position(['info', 'warning', 'error'], severity)) AS worst,
  arg_min(confidence, list_position(['indeterminate', 'low', 'medium', 'high'], confidence)) AS least_confidence, sha256(action || chr(31) || destination_url) AS recommendation_id FROM findings GROUP BY action, destination_url""")
def migration_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return migration.recommendations(_migration_findings(spark, d)[0])


NEW_LINKS = f"""SELECT page_id, concat('{NEW}/p/', page_id + 1) AS target FROM PAGES UNION ALL SELECT page_id, concat('{OLD}/p/', page_id) FROM PAGES WHERE page_id % 5 = 0 UNION ALL SELECT page_id, concat('https://staging.new.example/', page_id) FROM PAGES WHERE page_id % 7 = 0"""
EVIDENCE = {
    "new_links": NEW_LINKS,
    "entries": f"SELECT concat('{NEW}/p/', page_id) AS url FROM PAGES WHERE page_id % 4 <> 1 UNION ALL SELECT concat('{OLD}/p/', page_id) FROM PAGES WHERE page_id % 10 = 0 UNION ALL SELECT concat('https://else.example/', page_id) FROM PAGES WHERE page_id % 50 = 0",
    "old_images": f"SELECT concat('{OLD}/p/', page_id) AS page_url, concat('/i/', page_id % 3) AS src, CASE WHEN page_id % 6 <> 0 THEN 'Alt' END AS alt, '10' AS width, '10' AS height, 'lazy' AS loading FROM PAGES",
    "new_images": f"""SELECT concat('{NEW}/p/', page_id) AS page_url, concat('/i/', page_id % 3) AS src, CASE WHEN page_id % 5 = 1 THEN NULL WHEN page_id % 5 = 2 THEN 'Else' ELSE 'Alt' END AS alt, CASE WHEN page_id % 8 = 3 THEN '12' ELSE '10' END AS width, '10' AS height,
      CASE WHEN page_id % 9 <> 4 THEN 'lazy' END AS loading, concat(CASE page_id % 7 WHEN 0 THEN '{OLD}' WHEN 1 THEN 'https://dev.new.example' ELSE '{NEW}' END, '/i/', page_id % 3) AS resolved, CASE WHEN page_id % 13 = 2 THEN 404 ELSE 200 END AS http_status, page_id % 12 = 5 AS redirected FROM PAGES WHERE page_id % 4 <> 3""",
    "old_blocks": f"SELECT concat('{OLD}/p/', page_id) AS page_url, 'Article' AS type, 'json_ld' AS format, CAST(NULL AS {{text}}) AS error FROM PAGES WHERE page_id % 2 = 0",
    "new_blocks": f"SELECT concat('{NEW}/p/', page_id) AS page_url, CASE WHEN page_id % 8 = 4 THEN 'Product' ELSE 'Article' END AS type, CASE WHEN page_id % 5 = 2 THEN 'rdfa' ELSE 'json_ld' END AS format, CASE WHEN page_id % 16 = 2 THEN 'invalid_json' END AS error FROM PAGES WHERE page_id % 6 <> 0",
}
DUCK_EVIDENCE = ", ".join(f"{k} AS ({v.replace('FROM PAGES', 'FROM pages').replace('{text}', 'VARCHAR')})" for k, v in EVIDENCE.items())
OTHER_FINDINGS = f"""{DUCK_EVIDENCE}, li AS (SELECT l.page_id, target, http_status, redirect_count FROM new_links l LEFT JOIN new_pages n ON n.url = target),
  sm AS (SELECT e.url, http_status, redirect_count, indexable, canonical_url FROM entries e LEFT JOIN new_pages n ON n.url = e.url), pairs AS (SELECT source_url, destination_url FROM mapped WHERE destination_url IS NOT NULL),
  im AS (SELECT source_url, o.src, o.alt AS old_alt, n.alt, n.width, n.loading, n.src IS NOT NULL AS here FROM pairs JOIN old_images o ON o.page_url = source_url LEFT JOIN new_images n ON n.page_url = destination_url AND n.src = o.src),
  bl AS (SELECT source_url, n.type, n.format, n.error FROM pairs JOIN old_blocks o ON o.page_url = source_url LEFT JOIN new_blocks n ON n.page_url = destination_url),
  other(subject, target, code) AS (SELECT source_url, destination_url, 'mapping_unmapped' FROM mapped WHERE state = 'unmapped' UNION ALL SELECT source_url, destination_url, 'mapping_ambiguous' FROM mapped WHERE state = 'ambiguous'
    UNION ALL SELECT source_url, destination_url, unnest(['mapping_one_to_many', 'mapping_conflicting_explicit', 'redirect_one_to_many_review', 'content_split_review']) FROM mapped WHERE cardinality = 'one_to_many' UNION ALL SELECT source_url, destination_url, unnest(['mapping_many_to_one', 'mapping_destination_collision']) FROM mapped WHERE cardinality = 'many_to_one'
    UNION ALL SELECT CAST(page_id AS VARCHAR), target, 'internal_link_to_legacy_url' FROM li WHERE target LIKE '{OLD}/%' UNION ALL SELECT CAST(page_id AS VARCHAR), target, 'internal_link_to_redirect' FROM li WHERE redirect_count > 0 UNION ALL SELECT CAST(page_id AS VARCHAR), target, 'internal_link_to_broken_destination' FROM li WHERE http_status >= 400
    UNION ALL SELECT CAST(page_id AS VARCHAR), target, unnest(['internal_link_to_staging_host', 'internal_link_host_mismatch']) FROM li WHERE target LIKE 'https://staging.%'
    UNION ALL SELECT url, NULL, 'legacy_url_in_destination_sitemap' FROM sm WHERE url LIKE '{OLD}/%' UNION ALL SELECT url, NULL, 'redirecting_url_in_sitemap' FROM sm WHERE redirect_count > 0 UNION ALL SELECT url, NULL, 'broken_url_in_sitemap' FROM sm WHERE http_status >= 400 UNION ALL SELECT url, NULL, 'nonindexable_url_in_sitemap' FROM sm WHERE NOT indexable
    UNION ALL SELECT url, NULL, 'canonical_conflict_in_sitemap' FROM sm WHERE canonical_url <> url UNION ALL SELECT url, NULL, 'sitemap_host_mismatch' FROM sm WHERE url LIKE 'https://else.%' UNION ALL SELECT DISTINCT destination_url, NULL, 'destination_url_missing_from_sitemap' FROM pairs WHERE destination_url NOT IN (SELECT url FROM entries)
    UNION ALL SELECT page_url, resolved, 'image_legacy_host_reference' FROM new_images WHERE resolved LIKE '{OLD}%' UNION ALL SELECT page_url, resolved, 'image_staging_host_reference' FROM new_images WHERE resolved LIKE 'https://dev.%' UNION ALL SELECT page_url, resolved, 'image_broken_after_migration' FROM new_images WHERE http_status = 404 UNION ALL SELECT page_url, resolved, 'image_redirect_dependency' FROM new_images WHERE redirected
    UNION ALL SELECT source_url, src, 'image_missing_after_migration' FROM im WHERE NOT here UNION ALL SELECT source_url, src, CASE WHEN alt IS NULL THEN 'image_alt_missing_after_migration' ELSE 'image_alt_materially_changed' END FROM im WHERE here AND old_alt IS DISTINCT FROM alt
    UNION ALL SELECT source_url, src, 'image_dimension_regression' FROM im WHERE here AND width <> '10' UNION ALL SELECT source_url, src, 'image_loading_regression' FROM im WHERE here AND loading IS NULL
    UNION ALL SELECT source_url, NULL, 'structured_data_removed' FROM bl WHERE type IS NULL UNION ALL SELECT source_url, NULL, 'structured_data_type_changed' FROM bl WHERE type = 'Product' UNION ALL SELECT source_url, NULL, 'structured_data_format_changed' FROM bl WHERE type = 'Article' AND format = 'rdfa'
    UNION ALL SELECT source_url, NULL, 'structured_data_invalid_after_migration' FROM bl WHERE error IS NOT NULL)"""


def _migration_evidence(spark: SparkSession, d: str, mapped: DataFrame, new_pages: DataFrame) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id")
    own = {k: spark.sql(v.replace("FROM PAGES", "FROM {pages}").replace("{text}", "STRING"), pages=pages) for k, v in EVIDENCE.items()}
    row = lambda df, subject, target=None: df.select(F.col(subject).cast("string").alias("subject"), (F.lit(None).cast("string") if target is None else F.col(target)).alias("target"), "code")
    parts = (
        row(migration.mapping_findings(mapped), "source_url", "destination_url"),
        row(migration.link_findings(own["new_links"], new_pages, OLD, NEW), "page_id", "target"),
        row(migration.sitemap_findings(own["entries"], mapped, new_pages, OLD, NEW), "url"),
        row(migration.image_references(own["new_images"], OLD), "page_url", "resolved"),
        row(migration.image_findings(mapped, own["old_images"], own["new_images"]), "source_url", "src"),
        row(migration.structured_findings(mapped, own["old_blocks"], own["new_blocks"]), "source_url"),
    )
    return reduce(DataFrame.unionByName, parts)


@query(f"WITH {DUCK_MIGRATION}, {MAPPED}, {OTHER_FINDINGS} SELECT subject, target, code FROM other")
def migration_evidence_findings(spark: SparkSession, d: str) -> DataFrame:
    own = _migration(spark, d)
    return _migration_evidence(spark, d, own["mapped"], own["new_pages"])


def _sitewide_sql() -> str:
    wide = """legacy_host_references=internal_link_to_legacy_url,image_legacy_host_reference,legacy_url_in_destination_sitemap staging_host_references=internal_link_to_staging_host,image_staging_host_reference redirect_dependency=internal_link_to_redirect,image_redirect_dependency
      redirect_chain_pattern=redirect_chain temporary_redirect_pattern=redirect_temporary noindex_regression=destination_noindex_regression canonical_host_mismatch=canonical_points_to_wrong_host metadata_loss=title_missing_after_migration,meta_description_missing_after_migration
      sitemap_regression=destination_url_missing_from_sitemap,legacy_url_in_destination_sitemap structured_data_loss=structured_data_removed image_host_regression=image_legacy_host_reference,image_staging_host_reference unmapped_source_urls=mapping_unmapped destination_errors=destination_404,destination_410,destination_other_4xx,destination_5xx"""
    groups = ", ".join(f"('sitewide_{g}', '{c}')" for g, codes in (x.split("=") for x in wide.split()) for c in codes.split(","))
    return f"""WITH {DUCK_MIGRATION}, {MAPPED}, {MIGRATION_FINDINGS}, {OTHER_FINDINGS}, n AS (SELECT count(*) AS denominator FROM mapped), g AS (SELECT * FROM (VALUES {groups}) t(metric, code)), every AS (SELECT code FROM findings UNION ALL SELECT code FROM other),
      c AS (SELECT metric, CAST(sum(coalesce(n, 0)) AS BIGINT) AS numerator FROM g LEFT JOIN (SELECT code, count(*) AS n FROM every GROUP BY code) USING (code) GROUP BY metric)
      SELECT metric, numerator, denominator, printf('%.6f', numerator / denominator) AS ratio, CASE WHEN denominator < 10 THEN 'small_inventory' WHEN numerator >= greatest(2, floor(denominator * 0.2 + 0.999999)) THEN 'threshold_reached' ELSE 'below_threshold' END AS state FROM c, n"""


@query(_sitewide_sql())
def migration_sitewide(spark: SparkSession, d: str) -> DataFrame:
    own = _migration(spark, d)
    found = migration.findings(own["mapped"], own["planned"], own["old_pages"], own["new_pages"], OLD, NEW)
    return migration.sitewide(found.select("code").unionByName(_migration_evidence(spark, d, own["mapped"], own["new_pages"]).select("code")), own["mapped"])


@query(f"""WITH {DUCK_MIGRATION}, nl AS ({NEW_LINKS.replace("FROM PAGES", "FROM pages")}), status AS (SELECT url, http_status, redirect_count FROM new_pages), own AS (SELECT page_id, target, http_status, redirect_count, regexp_extract(target, '^([a-z]+://[^/?#]+)', 1) AS origin FROM nl LEFT JOIN status ON url = target)
  SELECT page_id, target, 'internal_link_to_legacy_url' AS code FROM own WHERE origin = '{OLD}' UNION ALL SELECT page_id, target, 'internal_link_to_redirect' FROM own WHERE redirect_count > 0 UNION ALL SELECT page_id, target, 'internal_link_to_broken_destination' FROM own WHERE http_status >= 400
  UNION ALL SELECT page_id, target, 'internal_link_to_staging_host' FROM own WHERE origin LIKE '%//staging.%' UNION ALL SELECT page_id, target, 'internal_link_host_mismatch' FROM own WHERE origin NOT IN ('{OLD}', '{NEW}')""")
def migration_link_findings(spark: SparkSession, d: str) -> DataFrame:
    own = _migration(spark, d)
    links_ = spark.sql(NEW_LINKS.replace("FROM PAGES", "FROM {pages}"), pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id"))
    return migration.link_findings(links_, own["new_pages"], OLD, NEW)


# -- result tables ----------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return resultset.latest(own, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_custkey > 10 OR (o_custkey = 10 AND o_orderkey > 5) ORDER BY o_custkey, o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey", "o_totalprice")
    return resultset.keyset_page(own, ["o_custkey", "o_orderkey"], (10, 5), 50)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def offset_page(spark: SparkSession, d: str) -> DataFrame:
    own = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    return resultset.offset_page(own, [F.desc("o_totalprice"), "o_orderkey"], 40, 20)


@query("""SELECT 'with_large_line' AS kind, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
  UNION ALL SELECT 'without_large_line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)""")
def semi_anti_filters(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    large = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    count = lambda kind, how: orders.join(large, "o_orderkey", how).agg(F.count(F.lit(1)).alias("orders")).select(F.lit(kind).alias("kind"), "orders")
    return count("with_large_line", "left_semi").unionByName(count("without_large_line", "left_anti"))


@query(f"WITH {duck_crawl()} SELECT page_id, url, http_status FROM crawl WHERE http_status BETWEEN 400 AND 499 AND title IS NOT NULL AND lower(url) LIKE '%/p/1%'")
def filtered_pages(spark: SparkSession, d: str) -> DataFrame:
    return resultset.filtered(Site(spark, d).crawl, {"class_http_status": 4, "has_title": True, "contains_url": "/P/1"}).select("page_id", "url", "http_status")


# -- reading of results -----------------------------------------------------------------------------------------------


@query(f"""WITH {duck_crawl()}, evidence AS ({TARGET_EVIDENCE}), {CLASSIFIED} SELECT target_page, broken_state, severity, source_pages FROM final JOIN (SELECT target_page, hop_count FROM evidence) USING (target_page)
  WHERE broken_state <> 'working_internal_link' AND severity = 'high' AND source_pages >= 2 ORDER BY source_pages DESC NULLS LAST, target_page LIMIT 40""")
def resource_link_targets(spark: SparkSession, d: str) -> DataFrame:
    found = _classified(spark, d).where("broken_state <> 'working_internal_link'")
    return reads.read("link_targets", found, {"severity": "high", "min_source_pages": 2}, "source_pages", True, size=40).select("target_page", "broken_state", "severity", "source_pages")


@query(f"{DUCK_IMAGES} SELECT page_id, index, src, reason, reuse FROM s3 WHERE severity = 'medium' AND src LIKE '%.png%' AND reuse >= 2 ORDER BY reuse DESC NULLS LAST, page_id, index LIMIT 50 OFFSET 5")
def resource_image_occurrences(spark: SparkSession, d: str) -> DataFrame:
    found = images.occurrences(_images(spark, d))
    return reads.read("image_occurrences", found, {"severity": "medium", "contains_src": ".PNG", "min_reuse": 2}, "reuse", True, 5).select("page_id", "index", "src", "reason", "reuse")


@query(f"WITH {duck_crawl()}, {_recommended_sql()} SELECT page_id, state, reasons FROM recommended WHERE state = 'exclude' AND reasons LIKE '%redirect%' ORDER BY page_id LIMIT 50")
def resource_recommendations(spark: SparkSession, d: str) -> DataFrame:
    found = sitemap.recommendations(Site(spark, d).crawl)
    return reads.read("recommendations", found, {"state": "exclude", "contains_reasons": "Redirect"}).select("page_id", "state", "reasons")


@query(_facts_sql() + " SELECT page_id, url, http_status, sitemap_state FROM facts WHERE recommendation = 'exclude' AND http_status BETWEEN 400 AND 499 AND in_sitemap ORDER BY http_status DESC NULLS LAST, page_id LIMIT 50")
def resource_combined_urls(spark: SparkSession, d: str) -> DataFrame:
    own = Site(spark, d).crawl_once()
    facts = combined.url_facts(own, sitemap.recommendations(own))
    return reads.read("combined_urls", facts, {"recommendation": "exclude", "class_http_status": 4, "in_sitemap": True}, "http_status", True).select("page_id", "url", "http_status", "sitemap_state")


@query(f"WITH {DUCK_MIGRATION}, {MAPPED}, {MIGRATION_FINDINGS} SELECT source_url, destination_url, code FROM findings WHERE severity = 'error' AND confidence = 'high' AND source_url LIKE '%/p/1%' ORDER BY code, source_url, destination_url LIMIT 50")
def resource_migration_findings(spark: SparkSession, d: str) -> DataFrame:
    found = _migration_findings(spark, d)[0]
    return reads.read("migration_findings", found, {"severity": "error", "confidence": "high", "contains_source_url": "/P/1"}, "code").select("source_url", "destination_url", "code")


@query(f"""WITH {duck_crawl()} SELECT count(*) AS pages, count(*) FILTER (WHERE category = 'html' AND http_status = 200) AS html_pages, count(*) FILTER (WHERE http_status IS NULL) AS failed_pages,
  count(*) FILTER (WHERE redirect_count >= 1) AS redirected_pages, count(*) FILTER (WHERE http_status >= 400) AS error_pages, count(*) FILTER (WHERE n_titles = 0) AS untitled_pages FROM crawl""")
def evidence_totals(spark: SparkSession, d: str) -> DataFrame:
    wanted = {"pages": "true", "html_pages": "parsed_as_html", "failed_pages": "fetch_failed", "redirected_pages": "redirect_count > 0", "error_pages": "http_status >= 400", "untitled_pages": "title_presence = 'missing'"}
    return reads.totals(Site(spark, d).crawl, wanted)


@query(f"""WITH {duck_crawl()}, evidence AS ({TARGET_EVIDENCE}), {CLASSIFIED} SELECT l.seq, l.source_page, l.target_page, f.reason, f.severity, f.source_pages FROM links l JOIN final f ON f.target_page = l.target_page WHERE f.broken_state = 'broken_internal_link'""")
def broken_links_export(spark: SparkSession, d: str) -> DataFrame:
    found = links.broken_links(Site(spark, d).links, _classified(spark, d), "target_page")
    return found.select("seq", "source_page", "target_page", "reason", "severity", "source_pages")


@query(f"""WITH {duck_crawl()}, evidence AS ({TARGET_EVIDENCE}), {CLASSIFIED}, hops AS ({HOPS}), per AS (SELECT page_id, [first(from_url ORDER BY sequence)] || list(to_url ORDER BY sequence) AS nodes, count(*) AS n FROM hops GROUP BY page_id)
  SELECT target_page, action, array_to_string(nodes, ' ') AS current_chain, coalesce(n, 0) AS hop_count, coalesce(len(list_distinct(nodes)) < len(nodes), false) AS loop FROM final LEFT JOIN per ON page_id = target_page WHERE action <> 'no_action'""")
def redirect_map_export(spark: SparkSession, d: str) -> DataFrame:
    own = links.chains(spark.sql(HOPS.replace("FROM crawl", "FROM {crawl}"), crawl=Site(spark, d).crawl)).withColumnRenamed("page_id", "target_page")
    found = links.redirect_map(_classified(spark, d).drop("hop_count"), own, "target_page")
    return found.select("target_page", "action", "current_chain", F.col("hop_count").cast("long").alias("hop_count"), "loop")


@query(f"""WITH {duck_crawl()}, seen AS (SELECT page_id, 'requested' AS kind, url AS u FROM crawl UNION ALL SELECT page_id, 'final', final_url FROM crawl WHERE final_url IS NOT NULL UNION ALL SELECT page_id, 'canonical', canonical_url FROM crawl WHERE canonical_url IS NOT NULL)
  SELECT page_id, kind, 'discovery' AS layer, 'exclude_from_discovery' AS outcome, CASE WHEN u LIKE '%/p/1%' THEN 'v2' ELSE 'v1' END AS primary_rule, CASE WHEN u LIKE '%/p/1%' AND u LIKE '%7' THEN 2 ELSE 1 END AS contributing, false AS conflict FROM seen WHERE u LIKE '%7' OR u LIKE '%/p/1%'""")
def governance_variants(spark: SparkSession, d: str) -> DataFrame:
    rules = [("v1", "path_ends_with", "7", False, "exclude_from_discovery", 1, "global", []), ("v2", "path_starts_with", "/p/1", False, "exclude_from_discovery", 1, "per_audit", [])]
    return governance.variant_decisions(Site(spark, d).crawl, {"requested": "url", "final": "final_url", "canonical": "canonical_url"}, rules)


@query(f"""WITH {URL_PARTS}, origins AS (SELECT DISTINCT scheme || '://' || hostname AS origin FROM parts), heard AS (SELECT origin || '/explicit.xml' AS url, 0 AS r FROM origins WHERE origin LIKE 'https%' UNION ALL SELECT origin || '/sitemap.xml', 0 FROM origins WHERE origin LIKE '%1%'
  UNION ALL SELECT origin || '/sitemap.xml', 1 FROM origins UNION ALL SELECT origin || '/' || p, 2 FROM origins, (VALUES ('sitemap.xml'), ('sitemap_index.xml'), ('wp-sitemap.xml')) t(p))
  SELECT url, ['explicit', 'robots', 'common_path'][min(r) + 1] AS source, array_to_string([['explicit', 'robots', 'common_path'][x + 1] FOR x IN list_sort(list_distinct(list(r)))], ',') AS sources FROM heard GROUP BY url""")
def sitemap_discovery(spark: SparkSession, d: str) -> DataFrame:
    origins = spark.read.parquet(f"{d}/pages.parquet").select(normalize_url("url").alias("u")).select(F.concat("u.scheme", F.lit("://"), "u.hostname").alias("origin")).distinct()
    explicit = origins.where("origin LIKE 'https%'").select(F.concat("origin", F.lit("/explicit.xml")).alias("url")).unionByName(origins.where("origin LIKE '%1%'").select(F.concat("origin", F.lit("/sitemap.xml")).alias("url")))
    outside = spark.createDataFrame([("https://elsewhere.test/sitemap.xml",)], "url string")
    return sitemap.discovered(origins, explicit.unionByName(outside), origins.select("origin", F.lit(ROBOTS).alias("body")))


@query("""WITH job AS (SELECT o_custkey AS run_id, max(o_orderkey) AS job_id FROM orders GROUP BY o_custkey), summary AS (SELECT o_custkey AS run_id, 100 * count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'P') AS bad FROM orders WHERE o_custkey % 5 <> 0 GROUP BY o_custkey),
  own AS (SELECT c_custkey AS run_id, job_id, coalesce(total, 0) AS evidence_count, coalesce(bad, 0) AS bad, CASE WHEN c_custkey % 4 = 0 THEN 'not_terminal' WHEN total IS NULL THEN 'no_evidence' WHEN c_custkey % 6 = 1 THEN 'not_retained' WHEN total > 1500 THEN 'too_many_pages' END AS reason FROM customer JOIN job ON run_id = c_custkey LEFT JOIN summary USING (run_id))
  SELECT run_id, job_id, evidence_count, CASE WHEN evidence_count = 0 THEN 'unavailable' WHEN bad > 0 THEN 'partial' ELSE 'complete' END AS evidence_state, reason IS NULL AS eligible, reason FROM own""")
def run_candidates(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("run_id"), "o_orderkey", "o_orderstatus")
    runs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("run_id"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'running' ELSE 'completed' END").alias("lifecycle"), F.lit(None).cast("timestamp").alias("terminal_at"))
    jobs = orders.select("run_id", F.col("o_orderkey").alias("job_id"), F.col("o_orderkey").alias("sequence"))
    summaries = orders.where("run_id % 5 <> 0").groupBy("run_id").agg((100 * F.count(F.lit(1))).alias("total_records"), F.count(F.when(F.col("o_orderstatus") == "P", 1)).alias("incomplete_records"))
    summaries = summaries.withColumn("retention_state", F.expr("CASE WHEN run_id % 6 = 1 THEN 'expired' ELSE 'retained' END"))
    return reads.run_candidates(runs, jobs, summaries, 1500).drop("sequence", "terminal_at")


@query(f"""WITH {duck_crawl()}, named AS (SELECT page_id, evidence_state, lower(trim(title)) AS t FROM crawl WHERE title <> '')
  SELECT page_id, 'title_duplicate' AS code, 'title' AS category, 'medium' AS severity, CASE WHEN evidence_state IN ('truncated', 'partial') THEN 'partial' ELSE 'determinate' END AS determinacy FROM named WHERE t IN (SELECT t FROM named GROUP BY t HAVING count(*) > 1)""")
def metadata_duplicate_issues(spark: SparkSession, d: str) -> DataFrame:
    return metadata.duplicate_issues(Site(spark, d).crawl, "title", "title_duplicate")


# Queries of further modules register themselves.
from auditlake.plans import migrations, readings, sitemaps  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES"]
