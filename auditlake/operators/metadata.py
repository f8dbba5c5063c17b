"""Metadata audit: issue rules, duplicate groups, summaries, pages by severity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.functions.text import nfkc_casefold

#: Limits of title and description lengths. Fixed values.
TITLE_SHORT, TITLE_LONG, DESCRIPTION_SHORT, DESCRIPTION_LONG = 20, 60, 70, 160
#: Code, category, severity. Fixed values.
TAXONOMY = (
    ("title_missing", "title", "medium"),
    ("title_empty", "title", "medium"),
    ("title_multiple", "title", "medium"),
    ("title_duplicate", "title", "medium"),
    ("title_conflicting", "title", "medium"),
    ("title_short", "title", "low"),
    ("title_long", "title", "low"),
    ("meta_description_missing", "meta_description", "medium"),
    ("meta_description_empty", "meta_description", "medium"),
    ("meta_description_multiple", "meta_description", "medium"),
    ("meta_description_duplicate", "meta_description", "medium"),
    ("meta_description_short", "meta_description", "low"),
    ("meta_description_long", "meta_description", "low"),
    ("canonical_missing", "canonical", "medium"),
    ("canonical_invalid", "canonical", "high"),
    ("canonical_self", "canonical", "information"),
    ("canonical_elsewhere", "canonical", "medium"),
    ("canonical_multiple", "canonical", "medium"),
    ("canonical_conflicting", "canonical", "high"),
    ("canonical_cross_host", "canonical", "low"),
    ("canonical_cross_scheme", "canonical", "low"),
    ("canonical_cross_port", "canonical", "low"),
    ("canonical_target_redirected", "canonical", "medium"),
    ("canonical_target_unavailable", "canonical", "high"),
    ("robots_denied", "robots", "medium"),
    ("meta_robots_noindex", "robots", "medium"),
    ("x_robots_tag_noindex", "robots", "medium"),
    ("crawler_specific_directive", "robots", "low"),
    ("unsupported_robots_directive", "robots", "information"),
    ("robots_indexability_conflict", "indexability", "high"),
    ("indexability_indeterminate", "indexability", "medium"),
    ("indexability_recommendation_mismatch", "indexability", "high"),
    ("status_redirect", "status", "information"),
    ("status_4xx", "status", "high"),
    ("status_5xx", "status", "critical"),
    ("status_missing", "status", "high"),
    ("redirect_loop", "status", "critical"),
    ("redirect_chain", "status", "medium"),
    ("redirect_cross_host", "status", "medium"),
    ("content_type_missing", "content_type", "low"),
    ("content_type_ambiguous", "content_type", "low"),
    ("content_type_unexpected", "content_type", "medium"),
    ("content_type_non_html", "content_type", "information"),
)
INCOMPLETE = ("partial", "cancelled", "truncated", "unavailable")
SEVERITIES = ("information", "low", "medium", "high", "critical")
RANK_SQL = "CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END"

#: Code and condition, in the order of evaluation. A condition sees page columns and its canonical target's t_*.
RULES = (
    ("status_missing", "http_status IS NULL"), ("status_4xx", "http_status BETWEEN 400 AND 499"), ("status_5xx", "http_status >= 500"),
    ("status_redirect", "http_status < 400 AND (http_status >= 300 OR redirect_count > 0)"), ("redirect_loop", "redirect_loop"), ("redirect_chain", "redirect_count > 1"), ("redirect_cross_host", "redirect_cross_host"),
    ("content_type_missing", "category = 'missing' AND NOT fetch_failed"), ("content_type_ambiguous", "category = 'ambiguous'"), ("content_type_non_html", "category NOT IN ('html', 'missing', 'ambiguous')"),
    ("title_missing", "parsed_as_html AND title_presence = 'missing'"), ("title_empty", "parsed_as_html AND title_presence = 'empty'"), ("title_multiple", "parsed_as_html AND title_presence = 'multiple'"),
    ("title_conflicting", "parsed_as_html AND title_presence = 'multiple'"),
    ("title_short", f"parsed_as_html AND title_presence IN ('single', 'multiple') AND title_length < {TITLE_SHORT}"), ("title_long", f"parsed_as_html AND title_presence IN ('single', 'multiple') AND title_length > {TITLE_LONG}"),
    ("meta_description_missing", "parsed_as_html AND description_presence = 'missing'"), ("meta_description_empty", "parsed_as_html AND description_presence = 'empty'"),
    ("meta_description_multiple", "parsed_as_html AND description_presence = 'multiple'"),
    ("meta_description_short", f"parsed_as_html AND description_presence IN ('single', 'multiple') AND description_length < {DESCRIPTION_SHORT}"),
    ("meta_description_long", f"parsed_as_html AND description_presence IN ('single', 'multiple') AND description_length > {DESCRIPTION_LONG}"),
    ("canonical_missing", "parsed_as_html AND canonical_presence = 'missing'"), ("canonical_invalid", "parsed_as_html AND canonical_presence = 'empty'"),
    ("canonical_self", "parsed_as_html AND canonical_identity = coalesce(final_identity, identity)"), ("canonical_elsewhere", "parsed_as_html AND canonical_identity <> coalesce(final_identity, identity)"),
    ("canonical_target_unavailable", "parsed_as_html AND canonical_identity <> coalesce(final_identity, identity) AND t_identity IS NULL"),
    ("canonical_target_redirected", "parsed_as_html AND canonical_identity <> coalesce(final_identity, identity) AND (t_redirect_count > 0 OR t_status BETWEEN 300 AND 399)"),
    ("canonical_multiple", "parsed_as_html AND canonical_count > 1"), ("canonical_conflicting", "parsed_as_html AND canonical_conflicting"), ("canonical_cross_host", "parsed_as_html AND canonical_cross_host"),
    ("canonical_cross_scheme", "parsed_as_html AND canonical_cross_scheme"), ("canonical_cross_port", "parsed_as_html AND canonical_cross_port"),
    ("crawler_specific_directive", "crawler_directive"), ("unsupported_robots_directive", "unsupported_directive"),
    ("robots_denied", "NOT robots_allowed"), ("meta_robots_noindex", "meta_noindex"), ("x_robots_tag_noindex", "header_noindex"), ("robots_indexability_conflict", "indexability_state = 'conflicting'"),
    ("indexability_indeterminate", "indexability_state = 'unavailable' AND NOT fetch_failed"), ("content_type_unexpected", "parsed_as_html AND category <> 'html'"),
)


def issues(pages: DataFrame) -> DataFrame:
    """page_id, code, category, severity, determinacy: one row for each page and rule that holds.

    The canonical target is looked up by identity among the pages; the taxonomy is a constant of a few dozen rows.
    """
    target = pages.select(F.col("identity").alias("t_identity"), F.col("http_status").alias("t_status"), F.col("redirect_count").alias("t_redirect_count"))
    joined = pages.join(target, F.col("canonical_identity") == F.col("t_identity"), "left")
    hit = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(code)) for code, rule in RULES)))
    kinds = pages.sparkSession.createDataFrame(TAXONOMY, "code string, category string, severity string")
    state = F.when(F.col("evidence_state").isin(*INCOMPLETE), "partial").otherwise("determinate")
    return joined.select("page_id", state.alias("determinacy"), F.explode(hit).alias("code")).join(F.broadcast(kinds), "code").select("page_id", "code", "category", "severity", "determinacy")


def _keyed(pages: DataFrame, value: str) -> DataFrame:
    return pages.where(F.col(value).isNotNull()).withColumn("normal", nfkc_casefold(F.col(value))).where("normal <> ''")


def duplicate_groups(pages: DataFrame, value: str, by: list[str], kind: str) -> DataFrame:
    """Groups of two or more pages whose value is equal under NFKC, case folding and collapsed white space; first_page is the smallest page_id."""
    grouped = _keyed(pages, value).groupBy(*by, "normal").agg(F.count(F.lit(1)).alias("members"), F.min("page_id").alias("first_page"))
    return grouped.where("members >= 2").select(*by, F.lit(kind).alias("kind"), F.sha2("normal", 256).alias("group_hash"), "members", "first_page")


def duplicate_samples(pages: DataFrame, value: str, by: list[str], kind: str, sample: int = 20) -> DataFrame:
    """duplicate_groups with sample: the smallest `sample` page_ids, kept by a top-k for each group, so that a group is never gathered.

    Reads pages twice: they should be a written table.
    """
    keyed = _keyed(pages, value).select(*by, "page_id", F.sha2("normal", 256).alias("group_hash"))
    place = F.row_number().over(Window.partitionBy(*by, "group_hash").orderBy("page_id"))
    listed = keyed.withColumn("place", place).where(F.col("place") <= sample)
    samples = listed.groupBy(*by, "group_hash").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), ",").alias("sample"))
    return duplicate_groups(pages, value, by, kind).join(samples, [*by, "group_hash"])


def duplicate_issues(pages: DataFrame, value: str, code: str) -> DataFrame:
    """page_id, code, category, severity, determinacy of the pages whose value others have too; pages: page_id, the value, evidence_state."""
    keyed = pages.where(F.col(value).isNotNull()).select("page_id", "evidence_state", nfkc_casefold(F.col(value)).alias("normal")).where("normal <> ''")
    groups = keyed.groupBy("normal").agg(F.count(F.lit(1)).alias("members")).where("members >= 2").select("normal")
    category, severity = next((k, v) for c, k, v in TAXONOMY if c == code)
    state = F.when(F.col("evidence_state").isin(*INCOMPLETE), "partial").otherwise("determinate")
    return keyed.join(groups, "normal", "left_semi").select("page_id", F.lit(code).alias("code"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), state.alias("determinacy"))


def histogram(found: DataFrame) -> DataFrame:
    """dimension, value, issues: counts by severity, category and code in one pass of grouping sets."""
    one = found.groupingSets([["severity"], ["category"], ["code"]], "severity", "category", "code").agg(F.count(F.lit(1)).alias("issues"), F.grouping_id().alias("g"))
    return one.select(F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").otherwise("code").alias("dimension"), F.coalesce("severity", "category", "code").alias("value"), "issues")


def ranked_pages(found: DataFrame) -> DataFrame:
    """page_id, highest, rank, issues, ordered by severity, then page."""
    own = found.withColumn("rank", F.expr(RANK_SQL)).groupBy("page_id").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("issues"))
    return own.select("page_id", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank")).alias("highest"), "rank", "issues").orderBy(F.desc("rank"), "page_id")
