"""Sitemaps: eligibility recommendations, comparison with a crawl, parsing, generation."""

from __future__ import annotations

from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MAX_ENTRIES, MAX_BYTES = 50_000, 50_000_000
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"

#: Rule, outcome, reason, condition, in rule order. Fixed values.
RECOMMENDATION_RULES = (
    ("01", "hard", "outside_scope", "NOT in_scope"), ("03", "indeterminate", "missing_required_evidence", "robots_allowed IS NULL"), ("03", "hard", "robots_denied", "robots_allowed = false"),
    ("04", "hard", "fetch_failed", "fetch_failed"), ("05", "hard", "redirect_source", "redirect_count > 0"), ("06", "hard", "missing_http_status", "NOT fetch_failed AND http_status IS NULL"),
    ("06", "hard", "non_200_status", "http_status <> 200"), ("07", "review", "ambiguous_content_type", "category IN ('ambiguous', 'missing') AND parsed_as_html"),
    ("07", "hard", "non_html_content", "category NOT IN ('html', 'ambiguous', 'missing')"), ("08", "hard", "generic_noindex", "meta_noindex OR header_noindex"),
    ("10", "hard", "canonical_points_elsewhere", "parsed_as_html AND NOT canonical_conflicting AND canonical_identity <> coalesce(final_identity, identity)"),
    ("11", "review", "conflicting_canonicals", "parsed_as_html AND canonical_conflicting"), ("11", "review", "missing_canonical", "parsed_as_html AND canonical_presence = 'missing'"),
    ("11b", "review", "severe_parser_recovery", "parser_recovered"),
)
#: State, action, reason and condition of an entry or page; the first that holds counts. Fixed values.
COMPARISONS = (
    ("sitemap_only_unverified", "review", "not_observed_in_selected_crawl", "identity IS NULL"),
    ("redirected_sitemap_url", "remove", "redirected_url", "present AND redirect_count > 0 AND final_identity IS NOT NULL"),
    ("redirected_sitemap_url", "review", "redirect_target_requires_review", "present AND redirect_count > 0"),
    ("noindex_sitemap_url", "remove", "noindex_url", "present AND (meta_noindex OR header_noindex)"),
    ("canonicalized_sitemap_url", "remove", "canonical_points_elsewhere", "present AND canonical_identity <> identity"),
    ("non_html_sitemap_url", "remove", "non_html_content", "present AND category <> 'missing' AND (category <> 'html' OR NOT parsed_as_html)"),
    ("sitemap_only_unverified", "review", "crawl_evidence_failed", "fetch_failed"),
    ("in_sitemap_but_excluded", "remove", "recommendation_exclude", "present AND recommendation = 'exclude'"),
    ("in_sitemap_but_excluded", "review", "recommendation_review", "present AND recommendation = 'review'"),
    ("in_sitemap_but_excluded", "review", "recommendation_indeterminate", "present AND recommendation = 'indeterminate'"),
    ("in_sitemap_and_eligible", "unchanged", "eligible_already_present", "present"),
    ("missing_from_sitemap", "add", "eligible_missing_from_sitemap", "recommendation = 'include'"),
    ("in_sitemap_but_excluded", "review", "recommendation_exclude", "recommendation = 'exclude'"),
    ("in_sitemap_but_excluded", "review", "recommendation_review", "recommendation = 'review'"),
    ("in_sitemap_but_excluded", "review", "recommendation_indeterminate", "true"),
)
COMPARED_RECOMMENDATION_SQL = """CASE WHEN identity IS NULL THEN NULL WHEN fetch_failed THEN 'indeterminate' WHEN redirect_count > 0 THEN 'exclude' WHEN meta_noindex OR header_noindex THEN 'exclude'
 WHEN canonical_identity <> identity THEN 'exclude' WHEN category <> 'html' OR NOT parsed_as_html THEN 'exclude' WHEN http_status = 200 THEN 'include' ELSE 'review' END"""


def recommendations(pages: DataFrame) -> DataFrame:
    """page_id, state, primary_reason, reasons: hard exclusions outweigh missing evidence, which outweighs review."""
    own = {o: F.array_compact(F.array(*(F.when(F.expr(c), F.lit(r)) for _, kind, r, c in RECOMMENDATION_RULES if kind == o))) for o in ("hard", "indeterminate", "review")}
    df = pages.withColumns(own)
    state = F.when(F.size("hard") > 0, "exclude").when(F.size("indeterminate") > 0, "indeterminate").when(F.size("review") > 0, "review").otherwise("include")
    primary = F.when(F.size("hard") > 0, F.element_at("hard", 1)).when(F.size("indeterminate") > 0, F.element_at("indeterminate", 1)).when(F.size("review") > 0, F.element_at("review", 1)).otherwise("eligible_html_page")
    return df.select("page_id", state.alias("state"), primary.alias("primary_reason"), F.array_join(F.concat("hard", "indeterminate", "review"), ",").alias("reasons"))


def projection(found: DataFrame) -> DataFrame:
    """state, primary_reason, pages."""
    return found.groupBy("state", "primary_reason").agg(F.count(F.lit(1)).alias("pages"))


def comparison(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """key, present, recommendation, state, action, reason for every page and sitemap entry (column key), by full outer join."""
    joined = entries.select(F.col("key").alias("entry")).distinct().join(pages, F.col("entry") == F.col("identity"), "full_outer")
    own = joined.withColumn("present", F.col("entry").isNotNull()).withColumn("recommendation", F.expr(COMPARED_RECOMMENDATION_SQL))
    outcome = F.coalesce(*(F.when(F.expr(when), F.struct(F.lit(state).alias("state"), F.lit(action).alias("action"), F.lit(reason).alias("reason"))) for state, action, reason, when in COMPARISONS))
    return own.withColumn("o", outcome).select(F.coalesce("identity", "entry").alias("key"), "present", "recommendation", "o.state", "o.action", "o.reason")


PARSED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("locations", T.ArrayType(T.StringType())), T.StructField("finding", T.StringType())])


def parse_sitemap(body: bytes | str | None) -> tuple[str, list[str], str | None]:
    """kind (urlset, sitemapindex, invalid), locations, finding; documents with declarations or packed bytes aren't read."""
    raw = body.encode() if isinstance(body, str) else bytes(body or b"")
    if raw[:2] == b"\x1f\x8b":
        return "invalid", [], "compressed_not_supported"
    if len(raw) > MAX_BYTES:
        return "invalid", [], "document_too_large"
    if b"<!DOCTYPE" in raw.upper() or b"<!ENTITY" in raw.upper():
        return "invalid", [], "unsafe_declaration"
    try:
        root = ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        return "invalid", [], "malformed_xml"
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    if name(root) not in ("urlset", "sitemapindex"):
        return "invalid", [], "unsupported_root"
    found = [(x.text or "").strip() for member in root for x in member if name(x) == "loc"]
    return name(root), [x for x in found if x], None if len(found) <= MAX_ENTRIES else "entry_limit_exceeded"


@F.pandas_udf(PARSED)
def parsed_sitemap(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_sitemap(b) for b in body], columns=["kind", "locations", "finding"])


def expand_indexes(documents: DataFrame, roots: list[str], depth: int = 3) -> DataFrame:
    """url, level, kind, locations, finding of root documents and the children that indexes name, each document once.

    documents: url, body of everything fetched. Levels are joins; a child seen before is a loop and isn't read again.
    """
    known = documents.select("url", parsed_sitemap("body").alias("p")).select("url", "p.*")
    level = known.where(F.col("url").isin(*roots)).withColumn("level", F.lit(0))
    seen = level
    for n in range(1, depth + 1):
        children = level.where("kind = 'sitemapindex'").select(F.explode("locations").alias("url")).distinct().join(seen.select("url"), "url", "left_anti")
        level = known.join(children, "url", "left_semi").withColumn("level", F.lit(n))
        seen = seen.unionByName(level)
    return seen


def xml_documents(urls: DataFrame, order: str = "sequence", most: int = MAX_ENTRIES) -> DataFrame:
    """document, entries, xml: one XML text for each `most` distinct urls in order, first occurrence kept."""
    first = urls.groupBy("url").agg(F.min(order).alias("at"))
    # The place of a URL: counts of coarse ranges, then a rank inside each, so no task sorts everything.
    ranged = first.withColumn("part", F.expr(f"at div {most}"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = ranged.join(starts.select("part", "start"), "part").withColumn("place", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy("at", "url")) - 1)

    def render(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        body = "".join(f"<url><loc>{escape(u)}</loc></url>" for u in rows["url"])
        text = f'<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="{NAMESPACE}">{body}</urlset>'
        return pd.DataFrame({"document": [int(rows["document"].iloc[0])], "entries": [len(rows)], "xml": [text]})

    # A document has a fixed most number of entries, so a group is bounded.
    return placed.select("url", "place", F.expr(f"place div {most}").alias("document")).groupBy("document").applyInPandas(render, "document long, entries long, xml string")


#: Where sitemaps usually are. Fixed values.
COMMON_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")
#: Where a sitemap was heard of, the first first.
PROVENANCE = ("explicit", "robots", "common_path")


def discovered(origins: DataFrame, explicit: DataFrame, robots: DataFrame) -> DataFrame:
    """url, source (where it was heard of first), sources (all, in that order) of the sitemaps of origins.

    origins: origin. explicit: url. robots: origin, body. A robots line names an absolute URL or a path. URLs outside the
    origins are left out.
    """
    line = F.explode(F.regexp_extract_all(F.col("body"), F.lit(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*(\S+)"), F.lit(1))).alias("named")
    told = robots.select("origin", line).select(F.when(F.col("named").startswith("/"), F.concat("origin", "named")).otherwise(F.col("named")).alias("url"))
    common = origins.select(F.explode(F.array(*(F.concat("origin", F.lit(p)) for p in COMMON_PATHS))).alias("url"))
    parts = [df.select("url", F.lit(i).alias("rank")) for i, df in enumerate((explicit, told, common))]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("url").agg(F.array_sort(F.collect_set("rank")).alias("ranks"))
    inside = merged.withColumn("origin", F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1)).join(origins.select("origin").distinct(), "origin", "left_semi")
    names = F.transform("ranks", lambda r: F.element_at(F.array(*map(F.lit, PROVENANCE)), r + 1))
    return inside.select("url", F.element_at(names, 1).alias("source"), F.array_join(names, ",").alias("sources"))
