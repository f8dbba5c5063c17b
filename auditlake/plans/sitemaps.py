"""Queries over existing sitemaps: their members, what is wrong with them, the index tree under budgets.

The tables hold no sitemaps. Every 64 pages are a site here: page m of a site is its document m, an XML text that is written by
the formulas below from the page's number and its real address, then read like any other. Documents 0 to 20 are indexes of
three or more children each, the others are lists of addresses; faults come with the remainders of m. The comparison SQL doesn't
read the XML: it states from the same remainders what must be found, and walks the tree one queue entry at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators import sitemap_members, sitemap_tree
from auditlake.plans.registry import query

SIZE = 64
#: Limits that some of the documents exceed.
BYTES, ENTRIES, CHILDREN = 1500, 7, 4

HOST = "concat('https://s', CAST(site AS STRING), '.example')"
#: A child of an index, k from 0: three below it, then its parent or itself where a loop is wanted.
CHILD = f"concat({HOST}, '/m', CAST(CASE WHEN k < 3 THEN 3 * m + k + 1 WHEN k = 3 AND m % 3 = 1 THEN (m - 1 - (m - 1) % 3) / 3 WHEN k = 4 THEN m ELSE 3 * m + k - 3 END AS BIGINT), '.xml')"
N_CHILDREN = "CASE WHEN m % 3 = 1 THEN 4 WHEN m % 7 = 2 THEN 5 ELSE 3 END"
N_ENTRIES = "CASE WHEN m % 41 = 40 THEN 0 ELSE 3 + m % 6 END"
#: A member of a list, k from 0. The last one is the page's real address, which is another site's.
ENTRY = f"""CASE WHEN k = 2 + m % 6 THEN concat('<url><loc>', replace(url, '&', '&amp;'), '</loc></url>') WHEN k = 1 AND m % 3 = 0 THEN concat('<url><loc> HTTPS://S', CAST(site AS STRING), '.Example/e', CAST(m AS STRING), '/0 </loc></url>')
  WHEN k = 1 AND m % 3 = 1 THEN '<url><lastmod>2024</lastmod></url>' WHEN k = 2 AND m % 4 = 0 THEN '<url><loc>  </loc></url>' WHEN k = 2 AND m % 4 = 1 THEN '<url><loc>ftp://files.example/a</loc></url>'
  WHEN k = 3 AND m % 4 = 2 THEN '<url><loc>https://no host/</loc></url>' ELSE concat('<url><loc>', {HOST}, '/e', CAST(m AS STRING), '/', CAST(k AS STRING), '</loc></url>') END"""


def documents_sql(source: str, duck: bool) -> str:
    """site, m, url, seed, final_url, status, content_type, body over source (page_id, url)."""

    def joined(n: str, one: str) -> str:
        one = one.replace("AS STRING", "AS VARCHAR") if duck else one
        return f"array_to_string(list_transform(range({n}), lambda k: {one}), '')" if duck else f"array_join(transform(filter(sequence(0, {n}), k -> k < {n}), k -> {one}), '')"

    space = "CASE WHEN m % 19 = 3 THEN '' WHEN m % 53 = 52 THEN ' xmlns=\"urn:other\"' ELSE ' xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\"' END"
    children = joined(N_CHILDREN, f"concat('<sitemap><loc>', {CHILD}, '</loc></sitemap>')")
    text = f"""CASE WHEN m <= 20 THEN concat('<sitemapindex', {space}, '>', CASE WHEN m = 17 THEN '' ELSE {children} END, '</sitemapindex>')
      WHEN m % 23 = 22 THEN '<!DOCTYPE urlset><urlset/>' WHEN m % 29 = 28 THEN '<urlset><!ENTITY a "b"></urlset>' WHEN m % 31 = 30 THEN '<urlset><url>' WHEN m % 37 = 36 THEN '<feed/>' WHEN m % 16 = 15 THEN '<html><body/></html>'
      ELSE concat('<urlset', {space}, '>', {joined(N_ENTRIES, ENTRY)}, CASE WHEN m % 47 = 46 THEN concat('<!--', repeat('x', {BYTES}), '-->') ELSE '' END, '</urlset>') END"""
    own = f"""SELECT site, m, concat({HOST}, '/m', CAST(m AS STRING), '.xml') AS url, concat({HOST}, '/') AS seed, concat({HOST}, '/m', CAST(CASE WHEN m % 11 = 7 THEN m - 1 ELSE m END AS STRING), '.xml') AS final_url,
      CASE WHEN m % 17 = 16 THEN NULL WHEN m % 13 = 9 THEN 404 WHEN m = 0 AND site % 8 = 7 THEN 500 ELSE 200 END AS status,
      CASE WHEN m % 43 = 42 THEN 'application/gzip' WHEN m % 16 = 15 AND m > 20 THEN 'text/html; charset=utf-8' WHEN m % 10 = 9 THEN 'text/plain' ELSE 'application/xml' END AS content_type, {text} AS body
      FROM (SELECT page_id, url, CAST(floor(page_id / {SIZE}) AS BIGINT) AS site, page_id % {SIZE} AS m FROM {source}) numbered"""
    return own.replace("AS STRING", "AS VARCHAR") if duck else own


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(documents_sql("{pages}", False), pages=spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url"))


def found(spark: SparkSession, d: str) -> sitemap_members.Sitemaps:
    return sitemap_members.sitemaps(documents(spark, d), BYTES, ENTRIES, CHILDREN)


#: What the formulas mean, stated by hand: a row for each document that is read, and for each member.
EXPECTED = f"""
docs AS ({documents_sql("pages", True)}),
numbered AS (SELECT *, CASE WHEN m <= 20 THEN 'sitemapindex' ELSE 'urlset' END AS root, CASE WHEN m = 17 THEN 0 WHEN m <= 20 THEN {N_CHILDREN} ELSE {N_ENTRIES} END AS n FROM docs),
judged AS (
  SELECT *, status = 200 AS fetched, CASE WHEN content_type = 'application/gzip' THEN 'gzip_not_supported' WHEN strlen(body) > {BYTES} THEN 'response_too_large'
    WHEN m > 20 AND m % 23 = 22 THEN 'doctype_forbidden' WHEN m > 20 AND m % 29 = 28 THEN 'entity_declaration_forbidden' WHEN m > 20 AND m % 31 = 30 THEN 'invalid_xml' WHEN m > 20 AND m % 37 = 36 THEN 'unsupported_root_element'
    WHEN m > 20 AND m % 16 = 15 THEN 'unexpected_content_type' END AS code
  FROM numbered
), parsed AS (SELECT * FROM judged WHERE fetched AND code IS NULL),
each AS (SELECT p.*, k, address FROM (SELECT *, unnest(range(least(n, CASE WHEN m <= 20 THEN {CHILDREN} ELSE {ENTRIES} END))) AS k FROM parsed) p JOIN (SELECT page_id // {SIZE} AS site, page_id % {SIZE} AS m, url AS address FROM pages) USING (site, m)),
members AS (
  SELECT site, url, m, k AS sequence, root = 'sitemapindex' AS child, CASE WHEN m <= 20 THEN {CHILD.replace("AS STRING", "AS VARCHAR")} END AS child_url,
    CASE WHEN m <= 20 THEN CASE WHEN k = 3 AND m = 1 THEN NULL END WHEN k = 2 + m % 6 THEN 'out_of_scope_location' WHEN k = 1 AND m % 3 = 0 THEN 'duplicate_location' WHEN k = 1 AND m % 3 = 1 THEN 'missing_location'
      WHEN k = 2 AND m % 4 = 0 THEN 'empty_location' WHEN k = 2 AND m % 4 = 1 THEN 'unsupported_scheme' WHEN k = 3 AND m % 4 = 2 THEN 'invalid_location' END AS code
  FROM each
), seen AS (SELECT *, row_number() OVER (PARTITION BY site, m, child_url ORDER BY sequence) > 1 AND child AS again FROM members),
entries AS (SELECT site, m, count(*) FILTER (WHERE NOT child AND code IS NULL) AS entries FROM seen GROUP BY site, m)"""


@query(f"""WITH {EXPECTED}, said AS (
    SELECT site, url, 0 AS phase, NULL AS sequence, code, 'error' AS severity, NULL AS detail FROM judged WHERE fetched AND code IS NOT NULL
    UNION ALL SELECT site, url, 1, NULL, 'unexpected_content_type', 'warning', 'content_type=text/plain' FROM parsed WHERE content_type = 'text/plain'
    UNION ALL SELECT site, url, 2, NULL, 'invalid_namespace', 'warning', CASE WHEN m % 19 = 3 THEN 'namespace=missing' ELSE 'namespace=urn:other' END FROM parsed WHERE m % 19 = 3 OR m % 53 = 52
    UNION ALL SELECT site, url, 3, NULL, CASE WHEN m <= 20 THEN 'child_count_limit_exceeded' ELSE 'url_count_limit_exceeded' END, 'error', 'observed=' || n || ' limit=' || CASE WHEN m <= 20 THEN {CHILDREN} ELSE {ENTRIES} END
      FROM parsed WHERE n > CASE WHEN m <= 20 THEN {CHILDREN} ELSE {ENTRIES} END
    UNION ALL SELECT site, url, 4, sequence, code, CASE code WHEN 'duplicate_location' THEN 'information' WHEN 'out_of_scope_location' THEN 'warning' ELSE 'error' END, CASE WHEN code = 'duplicate_location' THEN 'first_sequence=0' END FROM seen WHERE code IS NOT NULL
    UNION ALL SELECT site, url, 4, sequence, 'duplicate_location', 'information', 'first_sequence=0' FROM seen WHERE again
    UNION ALL SELECT site, url, 5, NULL, CASE WHEN m <= 20 THEN 'empty_sitemap_index' ELSE 'empty_url_set' END, 'warning', NULL FROM parsed WHERE n = 0
  ) SELECT site, url, CAST(row_number() OVER (PARTITION BY site, url ORDER BY phase, sequence) AS INTEGER) AS number, code, severity, sequence, detail FROM said""")
def sitemap_validation(spark: SparkSession, d: str) -> DataFrame:
    """Every finding in every sitemap document, in the order of the document."""
    return found(spark, d).findings


#: Budgets by site: each meets another one.
BUDGETS = f"""CASE WHEN site % 4 = 1 THEN 17 ELSE 100 END AS max_documents, CASE WHEN site % 5 = 4 THEN 2 ELSE 3 END AS max_depth, CASE WHEN site % 4 = 2 THEN {BYTES} * 5 ELSE 50000000 END AS max_bytes, CASE WHEN site % 4 = 3 THEN 20 ELSE 250000 END AS max_urls"""
ROOTS = f"SELECT site, url, m AS place, {BUDGETS} FROM {{docs}} WHERE m = 0 OR m = 30"

#: The queue, one entry a step, for all sites: state in one row of a site.
WALK = f"""{EXPECTED}, facts AS (
  SELECT j.site, j.url, final_url, strlen(body) AS size, fetched AND true AS fetched, coalesce(entries, 0) AS entries, fetched AND code IS NULL AS parsed, kids
  FROM judged j LEFT JOIN entries USING (site, m) LEFT JOIN (SELECT site, m, list(child_url ORDER BY sequence) AS kids FROM seen WHERE child AND NOT again GROUP BY site, m) USING (site, m)
), roots AS ({ROOTS.format(docs="docs")}), steps AS (
  SELECT site, 0 AS step, list({{'url': url, 'parent': CAST(NULL AS VARCHAR), 'depth': 0}} ORDER BY place) AS queue, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS finals, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS urls, false AS stopped,
    max(max_documents) AS max_documents, max(max_depth) AS max_depth, max(max_bytes) AS max_bytes, max(max_urls) AS max_urls, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS parent, 0 AS depth, CAST(NULL AS VARCHAR) AS what, CAST(NULL AS VARCHAR) AS code, false AS root_read, CAST([] AS VARCHAR[]) AS loops, CAST(NULL AS VARCHAR) AS final
  FROM roots GROUP BY site
  UNION ALL
  SELECT site, step + 1, queue[2:] || CASE WHEN takes THEN [{{'url': x, 'parent': q.url, 'depth': q.depth + 1}} FOR x IN kids IF NOT list_contains(list_append(done, q.url), x)] ELSE [] END,
    CASE WHEN reads THEN list_append(done, q.url) ELSE done END, CASE WHEN reads AND NOT alias AND final_url IS NOT NULL THEN list_append(finals, final_url) ELSE finals END, used + CASE WHEN reads THEN size ELSE 0 END,
    urls + CASE WHEN good AND NOT spent THEN entries ELSE 0 END, ends OR (reads AND NOT alias AND spent) OR (good AND NOT spent AND urls + entries > max_urls), max_documents, max_depth, max_bytes, max_urls, q.url, q.parent, q.depth,
    CASE WHEN NOT reads THEN NULL WHEN alias THEN 'skipped' WHEN good THEN 'fetched' ELSE 'failed' END,
    CASE WHEN again THEN NULL WHEN full_up THEN 'sitemap_document_limit_exceeded' WHEN deep THEN 'maximum_depth_exceeded' WHEN dry THEN 'response_too_large' WHEN alias THEN 'redirect_alias_duplicate'
      WHEN good AND NOT spent AND urls + entries > max_urls THEN 'total_url_limit_exceeded' WHEN spent AND good THEN 'response_too_large' WHEN NOT good AND q.parent IS NULL THEN 'fetch_failed' WHEN NOT good THEN 'child_fetch_failed' END,
    reads AND good AND q.depth = 0 AND parsed AND NOT spent, CASE WHEN takes THEN [x FOR x IN kids IF list_contains(list_append(done, q.url), x)] ELSE [] END, final_url
  FROM (
    SELECT *, reads AND NOT alias AND coalesce(fetched, false) AND used + size <= max_bytes AS good, used + size >= max_bytes AS spent,
      reads AND NOT alias AND coalesce(fetched, false) AND used + size < max_bytes AND urls + entries <= max_urls AND kids IS NOT NULL AS takes
    FROM (
      SELECT *, NOT again AND NOT full_up AND NOT deep AND NOT dry AS reads, NOT again AND (full_up OR (NOT deep AND dry)) AS ends, NOT again AND NOT full_up AND NOT deep AND NOT dry AND final_url IS NOT NULL AND list_contains(finals, final_url) AS alias
      FROM (
        SELECT s.*, s.queue[1] AS q, f.final_url, coalesce(f.size, 0) AS size, f.fetched, coalesce(f.entries, 0) AS entries, coalesce(f.parsed, false) AS parsed, f.kids, list_contains(s.done, s.queue[1].url) AS again,
          len(s.done) >= s.max_documents AS full_up, s.queue[1].depth > s.max_depth AS deep, s.used >= s.max_bytes AS dry
        FROM (SELECT site, step, queue, done, finals, used, urls, stopped, max_documents, max_depth, max_bytes, max_urls FROM steps WHERE NOT stopped AND len(queue) > 0) s LEFT JOIN facts f ON f.site = s.site AND f.url = s.queue[1].url
      )
    )
  )
), failed_too AS (SELECT *, what = 'failed' AND code IS NULL OR (what = 'failed' AND stopped) AS extra FROM steps),
told AS (
  SELECT site, code, CASE WHEN what IS NULL THEN parent ELSE url END AS document, CASE WHEN code = 'redirect_alias_duplicate' THEN final ELSE url END AS subject FROM failed_too WHERE code IS NOT NULL
  UNION ALL SELECT site, 'response_too_large', url, url FROM failed_too WHERE what = 'failed' AND stopped
  UNION ALL SELECT site, 'sitemap_index_loop', url, unnest(loops) FROM failed_too
)"""


@query(f"""WITH RECURSIVE {WALK}
  SELECT site, 'document' AS kind, what AS state, url AS document, parent AS subject, CAST(depth AS INTEGER) AS depth, row_number() OVER (PARTITION BY site ORDER BY step) AS number FROM steps WHERE what IS NOT NULL
  UNION ALL SELECT site, 'finding', code, document, subject, NULL, NULL FROM told""")
def sitemap_tree_walk(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the budgets of each site let be read, in reading order, and what was reported on the way."""
    tree = _tree(spark, d)
    own = tree.documents.select("site", F.lit("document").alias("kind"), "state", F.col("url").alias("document"), F.col("parent").alias("subject"), "depth", "number")
    told = tree.findings.select("site", F.lit("finding").alias("kind"), F.col("code").alias("state"), "document", "subject", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("long").alias("number"))
    return own.unionByName(told)


def _tree(spark: SparkSession, d: str) -> sitemap_tree.Tree:
    own = found(spark, d)
    docs = own.documents.select("site", "url", F.regexp_extract("url", "m(\\d+)\\.xml$", 1).cast("long").alias("m"))
    return sitemap_tree.expand(own, spark.sql(ROOTS.format(docs="{docs}"), docs=docs))


@query(f"""WITH RECURSIVE {WALK}, warned AS (
    SELECT site FROM told UNION SELECT s.site FROM steps s JOIN judged j ON j.site = s.site AND j.url = s.url WHERE what = 'fetched' AND (j.code IS NOT NULL OR content_type = 'text/plain' OR m % 19 = 3 OR m % 53 = 52 OR n > CASE WHEN m <= 20 THEN {CHILDREN} ELSE {ENTRIES} END OR n = 0
      OR EXISTS (SELECT 1 FROM seen x WHERE x.site = j.site AND x.m = j.m AND (x.code IS NOT NULL OR x.again)))
  ), partly AS (SELECT DISTINCT site FROM told WHERE code NOT IN ('fetch_failed', 'sitemap_index_loop'))
  SELECT site, CASE WHEN NOT bool_or(root_read) THEN 'failed' WHEN site IN (FROM partly) THEN 'partially_completed' WHEN site IN (FROM warned) THEN 'completed_with_warnings' ELSE 'completed' END AS state, site IN (FROM partly) AS partial,
    count(what) AS documents, max(urls) AS urls, max(used) AS bytes FROM steps GROUP BY site""")
def sitemap_audit_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How the audit of each site ended."""
    return _tree(spark, d).sites


# -- new sitemaps

#: Limits of the generated documents: bytes decide for most, entries for those of short addresses.
NEW_ENTRIES, NEW_BYTES, NEW_CHARACTERS = 40, 2700, 75
ADDRESSES = "SELECT page_id * 2 AS sequence, url FROM {pages} UNION ALL SELECT page_id * 2 + 1, concat('https://s.example/', CAST(page_id AS STRING)) FROM {pages} WHERE page_id % 400 < 100 UNION ALL SELECT page_id * 2 + 1, concat('https://s.example/', CAST(page_id - 50 AS STRING)) FROM {pages} WHERE page_id % 400 BETWEEN 100 AND 149"


@query(f"""WITH RECURSIVE named AS ({ADDRESSES.replace("AS STRING", "AS VARCHAR").format(pages="pages")}), parts AS (SELECT sequence, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1)) || coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), ''), '/') || coalesce('?' || nullif(regexp_extract(url, '[?]([^#]*)', 1), ''), '') AS normal FROM named),
  judged AS (SELECT *, CASE WHEN length(url) > {NEW_CHARACTERS} THEN 'url_too_long' WHEN url <> normal THEN 'invalid_url' END AS reason, strlen(replace(url, '&', '&amp;')) + 33 AS bytes FROM parts),
  placed AS (SELECT url, bytes, row_number() OVER (ORDER BY sequence, url) AS i FROM (SELECT url, min(sequence) AS sequence, any_value(bytes) AS bytes FROM judged WHERE reason IS NULL GROUP BY url)),
  walk AS (
    SELECT CAST(0 AS BIGINT) AS i, 1 AS number, 0 AS n, CAST(110 AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS why
    UNION ALL
    SELECT p.i, w.number + CASE WHEN n + 1 > {NEW_ENTRIES} OR b + p.bytes > {NEW_BYTES} THEN 1 ELSE 0 END, CASE WHEN n + 1 > {NEW_ENTRIES} OR b + p.bytes > {NEW_BYTES} THEN 1 ELSE n + 1 END, CASE WHEN n + 1 > {NEW_ENTRIES} OR b + p.bytes > {NEW_BYTES} THEN 110 + p.bytes ELSE b + p.bytes END,
      CASE WHEN n + 1 > {NEW_ENTRIES} THEN 'entry_limit' WHEN b + p.bytes > {NEW_BYTES} THEN 'byte_limit' ELSE w.why END
    FROM walk w JOIN placed p ON p.i = w.i + 1
  ), documents AS (SELECT number, count(*) AS entries, max(b) AS bytes, any_value(why) AS split_reason, string_agg('  <url>\n    <loc>' || replace(url, '&', '&amp;') || '</loc>\n  </url>\n', '' ORDER BY i) AS body FROM walk JOIN placed USING (i) GROUP BY number)
  SELECT 'document' AS kind, 'sitemap-' || number || '.xml' AS name, entries, bytes, split_reason AS reason, sha256('<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' || body || '</urlset>\n') AS content FROM documents
  UNION ALL SELECT 'index', 'sitemap-index.xml', count(*), strlen(x), NULL, sha256(x) FROM (SELECT '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n' || string_agg('  <sitemap>\n    <loc>https://s.example/maps/sitemap-' || number || '.xml</loc>\n  </sitemap>\n', '' ORDER BY number) || '</sitemapindex>\n' AS x, count(*) AS c FROM documents), documents GROUP BY x
  UNION ALL SELECT 'rejected', url, NULL, NULL, reason, NULL FROM judged WHERE reason IS NOT NULL""".replace("'  <url>\n    <loc>'", "'  <url>' || chr(10) || '    <loc>'").replace("'</loc>\n  </url>\n'", "'</loc>' || chr(10) || '  </url>' || chr(10)"))
def sitemap_bundle(spark: SparkSession, d: str) -> DataFrame:
    """New sitemap documents of the pages' real addresses, their index, and the addresses that can't stand in one."""
    from auditlake.operators.sitemap_bundle import bundle

    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url")
    made = bundle(spark.sql(ADDRESSES, pages=pages), "https://s.example/maps/", NEW_ENTRIES, NEW_BYTES, NEW_CHARACTERS)
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    documents = made.documents.select(F.lit("document").alias("kind"), "name", "entries", "bytes", F.col("split_reason").alias("reason"), F.sha2("xml", 256).alias("content"))
    index = made.index.select(F.lit("index"), "name", "entries", "bytes", F.col("warning"), F.sha2("xml", 256))
    return documents.union(index).union(made.rejections.select(F.lit("rejected"), "url", none, none, "reason", text))
