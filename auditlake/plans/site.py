"""The crawl that queries run on: real pages with response facts that are computed from page_id.

The tables hold no HTTP facts, canonicals or links between crawled pages; every such column here is a fixed formula of
page_id, the same in both dialects, and must not be read as a fact of a crawl.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.shared import written
from auditlake.sources import html

SITE = "https://site.example/p/"


def sha(expression: str, duck: bool) -> str:
    return f"sha256({expression})" if duck else f"sha2({expression}, 256)"


def crawl_sql(source: str, duck: bool) -> str:
    """Synthetic page facts over source (page_id, title, n_titles)."""
    place = lambda e: f"concat('{SITE}', {e})"
    half, before = "CAST(floor(page_id / 2) AS BIGINT)", "page_id - 1"
    return f"""
    SELECT page_id, title, n_titles, {place("page_id")} AS url, {sha(place("page_id"), duck)} AS identity, http_status, http_status IS NULL AS fetch_failed,
      CASE WHEN page_id % 40 = 13 THEN 'connect_timeout' WHEN http_status IS NULL THEN 'dns_error' END AS failure_code, category, redirect_count, page_id % 101 = 50 AS redirect_loop, page_id % 34 = 22 AS redirect_cross_host,
      CASE WHEN redirect_count > 0 THEN {place(before)} END AS final_url, CASE WHEN redirect_count > 0 THEN {sha(place(before), duck)} END AS final_identity,
      category = 'html' AND coalesce(http_status, 0) = 200 AS parsed_as_html, length(title) AS title_length, CASE WHEN n_titles = 0 THEN 'missing' WHEN title = '' THEN 'empty' WHEN n_titles = 1 THEN 'single' ELSE 'multiple' END AS title_presence,
      'missing' AS description_presence, 0 AS description_length, canonical_page, CASE WHEN canonical_page IS NOT NULL THEN {place("canonical_page")} END AS canonical_url,
      CASE WHEN canonical_page IS NOT NULL THEN {sha(place("canonical_page"), duck)} END AS canonical_identity, CASE WHEN canonical_page IS NULL THEN 'missing' ELSE 'single' END AS canonical_presence,
      CASE WHEN canonical_page IS NULL THEN 0 WHEN page_id % 31 = 3 THEN 2 ELSE 1 END AS canonical_count, page_id % 31 = 3 AS canonical_conflicting, page_id % 43 = 7 AS canonical_cross_host, page_id % 41 = 4 AS canonical_cross_scheme, page_id % 45 = 6 AS canonical_cross_port, page_id % 33 = 10 AS crawler_directive, page_id % 39 = 15 AS unsupported_directive,
      page_id % 23 <> 9 AS robots_allowed, page_id % 29 = 6 AS meta_noindex, page_id % 59 = 8 AS header_noindex, CASE WHEN page_id % 61 = 9 THEN 'conflicting' WHEN http_status IS NULL THEN 'unavailable' ELSE 'available' END AS indexability_state,
      CASE WHEN http_status IS NULL THEN 'fetch_failed' WHEN page_id % 47 = 11 THEN 'truncated' ELSE 'complete' END AS evidence_state, page_id % 4 <> 1 AS in_sitemap, true AS in_scope, page_id % 53 = 12 AS parser_recovered
    FROM (SELECT page_id, title, n_titles, CASE page_id % 20 WHEN 13 THEN NULL WHEN 3 THEN 404 WHEN 7 THEN 500 WHEN 17 THEN 410 ELSE 200 END AS http_status,
      CASE WHEN page_id % 19 = 4 THEN 'pdf' WHEN page_id % 37 = 5 THEN 'ambiguous' ELSE 'html' END AS category, CASE WHEN page_id % 34 = 22 THEN 2 WHEN page_id % 17 = 5 THEN 1 ELSE 0 END AS redirect_count,
      CASE WHEN page_id % 7 = 1 THEN NULL WHEN page_id % 13 = 2 THEN {half} ELSE page_id END AS canonical_page FROM {source}) facts"""


def links_sql(source: str) -> str:
    """Synthetic links between pages: seq, source_page, target_page, anchor, nofollow."""
    kinds = (
        ("page_id * 3 + 1", "'Page one'", "false", "(page_id * 3 + 1) % 11 <> 0"), ("page_id * 3 + 2", "'read more'", "page_id % 5 = 4", "(page_id * 3 + 2) % 11 <> 0"), ("CAST(floor(page_id / 3) AS BIGINT)", "'Up'", "false", "page_id > 0"),
        ("0", "'home'", "page_id % 9 = 8", "page_id % 2 = 0"), ("page_id + 1", "'Page one'", "false", "page_id % 6 = 0"),
    )
    one = " UNION ALL ".join(f"SELECT page_id * 10 + {i} AS seq, page_id AS source_page, {t} AS target_page, {a} AS anchor, {n} AS nofollow FROM {source} WHERE {w}" for i, (t, a, n, w) in enumerate(kinds))
    return f"SELECT l.* FROM ({one}) l JOIN {source} p ON p.page_id = l.target_page"


#: Real evidence by regular expressions, for the DuckDB side.
DUCK_BASE = """SELECT page_id, url AS real_url, replace(trim(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')), '&amp;', '&') AS title, len(regexp_extract_all(html, '<title>')) AS n_titles FROM pages"""


def duck_crawl() -> str:
    return f"base AS ({DUCK_BASE}), crawl AS ({crawl_sql('base', True)}), links AS ({links_sql('base')})"


class Site:
    """DataFrames of one sf_dir: base (real), crawl and links (synthetic facts)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
        self.evidence = html.parsed(self.pages)

    @property
    def base(self) -> DataFrame:
        titles = F.col("evidence.titles")
        return self.evidence.select("page_id", F.col("url").alias("real_url"), F.try_element_at(titles, F.lit(1)).alias("title"), F.size(titles).cast("long").alias("n_titles"))

    @property
    def crawl(self) -> DataFrame:
        return self.spark.sql(crawl_sql("{base}", False), base=self.base)

    def crawl_once(self) -> DataFrame:
        """crawl, for queries that join it with itself: what it needs of the pages is parsed and written once, then read by each side."""
        return self.spark.sql(crawl_sql("{base}", False), base=written(self.base, "base"))

    @property
    def links(self) -> DataFrame:
        return self.spark.sql(links_sql("{base}"), base=self.pages.select("page_id"))

    def graph_links(self) -> DataFrame:
        """links by identities, with normalised anchors."""
        address = lambda c: F.sha2(F.concat(F.lit(SITE), F.col(c).cast("string")), 256)
        return self.links.select("seq", address("source_page").alias("source"), address("target_page").alias("target"), F.lower(F.trim("anchor")).alias("anchor"), "nofollow")
