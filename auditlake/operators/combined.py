"""Combined audit: URL facts, populations, findings, issue groups, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Facts of a URL by name. Fixed values.
FACTS = {
    "fetch_state": "CASE WHEN fetch_failed THEN 'failed' ELSE 'fetched' END",
    "parse_state": "CASE WHEN parsed_as_html THEN 'parsed_html' ELSE 'not_html' END",
    "robots_state": "CASE WHEN robots_allowed THEN 'allowed' WHEN robots_allowed = false THEN 'blocked' ELSE 'unavailable' END",
    "redirect_state": "CASE WHEN redirect_count > 0 THEN 'redirected' ELSE 'not_redirected' END",
    "canonical_state": "CASE WHEN canonical_presence = 'single' AND (canonical_identity = identity OR canonical_identity = final_identity) THEN 'canonical' WHEN canonical_presence = 'missing' THEN 'missing' ELSE 'indeterminate' END",
    "indexability": "CASE WHEN robots_allowed = false THEN 'not_indexable' WHEN parsed_as_html AND http_status BETWEEN 200 AND 299 THEN 'indexable' ELSE 'indeterminate' END",
}
#: Populations and the condition on facts. Fixed values.
POPULATIONS = (
    ("discovered", "true"), ("enqueued", "true"), ("fetched", "fetch_state = 'fetched'"), ("parsed_html", "parse_state = 'parsed_html'"), ("indexable", "indexability = 'indexable'"), ("canonical", "canonical_state = 'canonical'"),
    ("metadata_scoring_eligible", "parse_state = 'parsed_html' AND indexability = 'indexable' AND canonical_state = 'canonical'"), ("sitemap_eligible", "recommendation = 'include'"),
    ("resource", "parse_state = 'not_html' AND fetch_state = 'fetched'"), ("excluded", "recommendation = 'exclude'"), ("partial", "evidence_state <> 'complete'"), ("failed", "fetch_failed"),
    ("indeterminate", "indexability = 'indeterminate' OR canonical_state = 'indeterminate'"),
)
#: Code, condition, module, severity, impacts on indexability and sitemap. Fixed values.
FINDINGS = (
    ("metadata_title_missing", "parsed_as_html AND title_presence IN ('missing', 'empty')", "metadata", "high", 1, 1), ("metadata_description_missing", "parsed_as_html AND description_presence IN ('missing', 'empty')", "metadata", "medium", 1, 1),
    ("long_title", "parsed_as_html AND title_length > 60", "metadata", "medium", 1, 1), ("status_error", "http_status >= 400", "status_and_redirects", "high", 0, 0), ("robots_blocked", "robots_allowed = false", "robots_and_indexability", "high", 0, 0),
    ("canonical_missing", "parsed_as_html AND canonical_presence = 'missing'", "canonicals", "medium", 1, 0),
)
SEVERITY_PLACE_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
MOST = 100_000

COMBINED_SITEMAP_SQL = """CASE WHEN evidence_state <> 'complete' THEN 'indeterminate' WHEN fetch_failed OR http_status >= 400 THEN 'broken' WHEN category NOT IN ('html', 'missing') THEN 'non_html'
 WHEN redirect_state = 'redirected' THEN 'redirect_source' WHEN canonical_state <> 'canonical' THEN 'indeterminate' WHEN recommendation = 'include' AND in_sitemap THEN 'valid_unchanged' WHEN recommendation = 'include' THEN 'add'
 WHEN recommendation = 'exclude' AND in_sitemap THEN 'remove' WHEN recommendation = 'review' THEN 'review' WHEN robots_state = 'blocked' THEN 'not_crawlable' ELSE 'excluded_by_rule' END"""


def url_facts(pages: DataFrame, recommended: DataFrame) -> DataFrame:
    """pages with the facts and their recommendation (page_id, state)."""
    own = pages.join(recommended.select("page_id", F.col("state").alias("recommendation")), "page_id", "left").withColumns({k: F.expr(v) for k, v in FACTS.items()})
    return own.withColumn("sitemap_state", F.expr(COMBINED_SITEMAP_SQL))


def populations(facts: DataFrame) -> DataFrame:
    """population, urls. Populations without a URL have no row."""
    own = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(n)) for n, c in POPULATIONS)))
    return facts.select(F.explode(own).alias("population")).groupBy("population").agg(F.count(F.lit(1)).alias("urls"))


def findings(pages: DataFrame) -> DataFrame:
    """page_id, code, module, severity, index_place, sitemap_place (0 where the finding has the impact)."""
    hit = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(code)) for code, c, *_ in FINDINGS)))
    kinds = pages.sparkSession.createDataFrame([(code, m, s, i, x) for code, _, m, s, i, x in FINDINGS], "code string, module string, severity string, index_place int, sitemap_place int")
    return pages.select("page_id", F.explode(hit).alias("code")).join(F.broadcast(kinds), "code").select("page_id", "code", "module", "severity", "index_place", "sitemap_place")


def issue_groups(found: DataFrame) -> DataFrame:
    """code, severity, affected, first_page, priority: groups by code under a key that sorts as text."""
    own = found.groupBy("code", "module", "severity", "index_place", "sitemap_place").agg(F.countDistinct("page_id").alias("affected"), F.min("page_id").alias("first_page"))
    parts = [F.expr(SEVERITY_PLACE_SQL), F.col("index_place"), F.col("sitemap_place"), F.lit(MOST) - F.least(F.col("affected"), F.lit(MOST))]
    key = F.concat_ws("|", *(F.lpad(p.cast("string"), 6, "0") for p in parts), "code")
    return own.select("code", "module", "severity", "affected", "first_page", key.alias("priority"))


def summary(facts: DataFrame, found: DataFrame) -> DataFrame:
    """dimension, value, urls: populations, severities, recommendations and modules, and the affected URLs as a whole."""
    by = lambda df, name, c, key: df.groupBy(F.col(c).alias("value")).agg(F.countDistinct(key).alias("urls")).select(F.lit(name).alias("dimension"), "value", "urls")
    return (
        populations(facts).select(F.lit("population").alias("dimension"), F.col("population").alias("value"), "urls").unionByName(by(found, "severity", "severity", "page_id")).unionByName(by(facts, "recommendation", "recommendation", "page_id"))
        .unionByName(by(found, "module", "module", "page_id")).unionByName(found.agg(F.countDistinct("page_id").alias("urls")).select(F.lit("affected").alias("dimension"), F.lit("all").alias("value"), "urls"))
    )


#: Populations that must lie inside others. Fixed values.
INSIDE = (("parsed_html", "fetched"), ("fetched", "enqueued"), ("enqueued", "discovered"), ("metadata_scoring_eligible", "canonical"), ("metadata_scoring_eligible", "indexable"), ("metadata_scoring_eligible", "parsed_html"))


def broken_invariants(facts: DataFrame) -> list[str]:
    """The pairs of INSIDE that some URL violates, in one aggregation."""
    test = dict(POPULATIONS)
    row = facts.agg(*(F.count_if(F.expr(f"({test[a]}) AND NOT coalesce({test[b]}, false)")).alias(f"{a} in {b}") for a, b in INSIDE)).first()
    return [k for k, n in row.asDict().items() if n]


def artifacts(facts: DataFrame, found: DataFrame, rule_matches: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a combined audit's outputs by name, each in its order."""
    groups = issue_groups(found)
    out = {
        "pages": facts.orderBy("page_id"), "evidence": facts.select("page_id", "url", "http_status", "category", "title", "evidence_state").orderBy("page_id"), "issues": groups.orderBy("priority"),
        "comparison": facts.select("page_id", "url", "in_sitemap", "recommendation", "sitemap_state").orderBy("page_id"), "exclusions": facts.where("recommendation = 'exclude'").select("page_id", "url").orderBy("page_id"),
        "sitemap_urls": facts.where("recommendation = 'include'").select("page_id", "url").orderBy("page_id"), "action_plan": groups.select("priority", "code", "affected").orderBy("priority"), "summary": summary(facts, found).orderBy("dimension", "value"),
    }
    return out | ({} if rule_matches is None else {"rules": rule_matches.orderBy("url_id", "rule_id")})
