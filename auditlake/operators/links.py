"""Link audit: targets, classification of targets and redirects, chains, findings and recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import stable_id

#: A target linked from so many pages, and from such a share of at least so many parsed pages, is sitewide.
SITEWIDE_SOURCES, SITEWIDE_PAGES, SITEWIDE_RATIO = 5, 5, 0.5
MAX_HOPS = 10

#: Conditions in order, each with the values of OUTCOME. A condition sees the columns of one joined link target. Fixed values.
TARGET_RULES = (
    ("NOT source_available", ("source_page_unavailable", "source_fetch_failed", "no_redirect", "none", "medium", "review", "low")),
    ("source_partial", ("source_page_unavailable", "source_parse_partial", "no_redirect", "none", "medium", "review", "low")),
    ("internal = false", ("external_link_not_audited", "external_target", "no_redirect", "none", "info", "no_action", "high")),
    ("in_scope = false", ("out_of_scope_internal_target", "target_out_of_scope", "no_redirect", "none", "medium", "review", "low")),
    ("redirect_loop", ("redirecting_internal_link", "redirect", "redirect_loop", "redirect_loop_detected", "critical", "replace_redirect", "high")),
    (f"hop_count > {MAX_HOPS}", ("redirecting_internal_link", "redirect", "redirect_chain", "redirect_chain_too_long", "high", "replace_redirect", "high")),
    ("hop_count > 0 AND final_internal = false", ("redirecting_internal_link", "redirect", "redirect_to_external_target", "redirect_target_external", "medium", "review", "medium")),
    ("hop_count > 0 AND final_in_scope = false", ("redirecting_internal_link", "redirect", "redirect_to_out_of_scope_target", "redirect_target_out_of_scope", "medium", "review", "low")),
    ("hop_count > 0 AND category NOT IN ('html', 'missing')", ("redirecting_internal_link", "redirect", "redirect_to_non_html_target", "redirect_target_non_html", "medium", "review", "medium")),
    ("hop_count > 0 AND fetch_failed", ("target_fetch_failed", "target_fetch_failed", "redirect_unverified", "redirect_target_fetch_failed", "high", "review", "low")),
    ("hop_count > 0 AND http_status = 404", ("redirecting_internal_link", "redirect", "redirect_to_broken_target", "redirect_target_404", "high", "review", "high")),
    ("hop_count > 0 AND http_status = 410", ("redirecting_internal_link", "redirect", "redirect_to_broken_target", "redirect_target_410", "high", "review", "high")),
    ("hop_count > 0 AND http_status BETWEEN 400 AND 499", ("redirecting_internal_link", "redirect", "redirect_to_broken_target", "redirect_target_other_4xx", "high", "review", "high")),
    ("hop_count > 0 AND http_status >= 500", ("redirecting_internal_link", "redirect", "redirect_to_broken_target", "redirect_target_5xx", "critical", "review", "high")),
    ("hop_count > 0 AND http_status IS NULL", ("redirecting_internal_link", "redirect", "redirect_unverified", "redirect_target_unverified", "high", "review", "low")),
    ("hop_count > 1 AND n_permanent > 0 AND n_temporary > 0", ("redirecting_internal_link", "redirect", "redirect_chain", "mixed_redirect_chain", "high", "update_link_to_final_destination", "high")),
    ("hop_count > 1 AND n_permanent = hop_count", ("redirecting_internal_link", "redirect", "redirect_chain", "permanent_redirect", "high", "update_link_to_final_destination", "high")),
    ("hop_count > 1", ("redirecting_internal_link", "redirect", "redirect_chain", "temporary_redirect", "high", "update_link_to_final_destination", "high")),
    ("hop_count = 1 AND n_permanent = 1", ("redirecting_internal_link", "redirect", "single_redirect", "permanent_redirect", "medium", "update_link_to_final_destination", "high")),
    ("hop_count = 1", ("redirecting_internal_link", "redirect", "single_redirect", "temporary_redirect", "medium", "update_link_to_final_destination", "high")),
    ("category NOT IN ('html', 'missing')", ("target_non_html", "target_non_html", "no_redirect", "none", "medium", "review", "medium")),
    ("http_status = 404", ("broken_internal_link", "target_404", "no_redirect", "none", "high", "remove_link", "high")),
    ("http_status = 410", ("broken_internal_link", "target_410", "no_redirect", "none", "high", "remove_link", "high")),
    ("http_status BETWEEN 400 AND 499", ("broken_internal_link", "target_other_4xx", "no_redirect", "none", "high", "remove_link", "high")),
    ("http_status >= 500", ("broken_internal_link", "target_5xx", "no_redirect", "none", "high", "remove_link", "high")),
    ("fetch_failed AND lower(failure_code) LIKE '%timeout%'", ("target_fetch_failed", "target_timeout", "no_redirect", "none", "medium", "review", "medium")),
    ("fetch_failed AND lower(failure_code) LIKE '%dns%'", ("target_fetch_failed", "target_dns_failure", "no_redirect", "none", "medium", "review", "medium")),
    ("fetch_failed AND (lower(failure_code) LIKE '%block%' OR lower(failure_code) LIKE '%robots%')", ("target_fetch_failed", "target_blocked", "no_redirect", "none", "medium", "review", "medium")),
    ("fetch_failed", ("target_fetch_failed", "target_fetch_failed", "no_redirect", "none", "medium", "review", "medium")),
    ("http_status IS NULL", ("unverified_internal_link", "target_not_crawled", "no_redirect", "none", "medium", "review", "low")),
    ("true", ("working_internal_link", "working", "no_redirect", "none", "info", "no_action", "high")),
)
OUTCOME = ("broken_state", "reason", "redirect_state", "redirect_reason", "severity", "action", "confidence")


def outcome_sql(name: str) -> str:
    """One column of OUTCOME: the value of the first rule that holds."""
    at = OUTCOME.index(name)
    return "CASE " + " ".join(f"WHEN {when} THEN '{values[at]}'" for when, values in TARGET_RULES) + " END"


def page_index(pages: DataFrame, *columns: str) -> DataFrame:
    """One page for each identity: the page requested under it, else the first whose redirects end there."""
    wanted = pages.select(F.col("identity").alias("key"), F.lit(0).alias("way"), *columns)
    ended = pages.where("final_identity is not null").select(F.col("final_identity").alias("key"), F.lit(1).alias("way"), *columns)
    best = F.min_by(F.struct(*columns), F.struct("way", "page_id")).alias("p")
    return wanted.unionByName(ended).groupBy("key").agg(best).select("key", "p.*")


def targets(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row for each target: sources, occurrences, anchors, sitewide flag, first occurrence.

    Counts are two aggregations over (target, source) and (target, anchor), so a target that every page links to is
    pre-aggregated before it meets in one place.
    """
    by = by or []
    pages = links.groupBy(*by).agg(F.countDistinct("page_id").alias("parsed_pages"))
    first = F.min_by(F.col("href"), F.struct("page_id", "link_sequence")).alias("first_href")
    pairs = links.groupBy(*by, "target_identity", "resolved", "page_id").agg(F.count(F.lit(1)).alias("n"), first, F.collect_set(F.when(F.col("anchor") != "", F.col("anchor"))).alias("anchors"))
    per = pairs.groupBy(*by, "target_identity", "resolved").agg(
        F.count(F.lit(1)).alias("source_pages"), F.sum("n").alias("occurrences"), F.min_by("first_href", "page_id").alias("first_href"), F.min("page_id").alias("first_page")
    )
    anchors = links.where("anchor <> ''").select(*by, "target_identity", "anchor").distinct().groupBy(*by, "target_identity").agg(F.count(F.lit(1)).alias("unique_anchors"))
    joined = per.join(anchors, [*by, "target_identity"], "left")
    joined = joined.join(F.broadcast(pages), by) if by else joined.crossJoin(F.broadcast(pages))  # one row
    wide = (F.col("parsed_pages") >= SITEWIDE_PAGES) & (F.col("source_pages") >= SITEWIDE_SOURCES) & (F.col("source_pages") / F.col("parsed_pages") >= SITEWIDE_RATIO)
    return joined.select(*by, "target_identity", "resolved", "source_pages", "occurrences", F.coalesce("unique_anchors", F.lit(0)).alias("unique_anchors"), "first_page", "first_href", wide.alias("sitewide"))


def classified(evidence: DataFrame) -> DataFrame:
    """evidence with the outcome columns of TARGET_RULES; a sitewide broken target is critical."""
    out = evidence.withColumns({name: F.expr(outcome_sql(name)) for name in OUTCOME})
    return out.withColumn("severity", F.when(F.col("sitewide") & (F.col("broken_state") == "broken_internal_link"), "critical").otherwise(F.col("severity")))


def with_loop(hops: Column) -> Column:
    """Whether a URL occurs twice among the nodes of a chain."""
    return F.size(hops) > F.size(F.array_distinct(hops))


def chains(hops: DataFrame) -> DataFrame:
    """page_id, nodes, hop_count, loop, mixed, chain_id of each redirected page. hops: page_id, sequence, from_url, to_url, status."""
    listed = hops.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "from_url", "to_url", "status"))).alias("h"))
    nodes = F.concat(F.slice(F.transform("h", lambda x: x["from_url"]), 1, 1), F.transform("h", lambda x: x["to_url"]))
    statuses = F.transform("h", lambda x: x["status"])
    permanent, temporary = F.array(F.lit(301), F.lit(308)), F.array(F.lit(302), F.lit(303), F.lit(307))
    own = listed.select("page_id", nodes.alias("nodes"), F.size("h").alias("hop_count"), F.arrays_overlap(statuses, permanent).alias("p"), F.arrays_overlap(statuses, temporary).alias("t"))
    return own.select("page_id", F.array_join("nodes", " ").alias("nodes"), "hop_count", with_loop(F.col("nodes")).alias("loop"), (F.col("p") & F.col("t")).alias("mixed"), F.sha2(F.array_join("nodes", chr(0)), 256).alias("chain_id"))


def recommendations(found: DataFrame) -> DataFrame:
    """One for each classified target: action, confidence, reason, whether a person must look."""
    reason = F.when(F.col("redirect_state") != "no_redirect", F.col("redirect_reason")).otherwise(F.col("reason"))
    review = (F.col("confidence") != "high") | F.col("action").isin("create_redirect", "replace_redirect", "review")
    return found.select("target_identity", "action", "confidence", reason.alias("reason_code"), "severity", review.alias("human_review"), "source_pages", "occurrences")


def findings(found: DataFrame) -> DataFrame:
    """The targets whose severity isn't info, under a stable id."""
    code = F.when(F.col("redirect_state") != "no_redirect", F.col("redirect_reason")).otherwise(F.col("reason"))
    return found.where("severity <> 'info'").select(stable_id("target_identity", code).alias("finding_id"), "target_identity", code.alias("code"), "severity")


def broken_links(occurrences: DataFrame, found: DataFrame, key: str = "target_identity") -> DataFrame:
    """Every occurrence of a link to a broken internal target, with the target's outcome columns."""
    broken = found.where("broken_state = 'broken_internal_link'").select(key, "reason", "severity", "action", "confidence", "source_pages")
    return occurrences.join(broken, key)


def redirect_map(recommended: DataFrame, redirect_chains: DataFrame, key: str) -> DataFrame:
    """recommended targets that ask for an action, with their chains (columns key, nodes, hop_count, loop), if they have any."""
    chain = redirect_chains.select(key, F.col("nodes").alias("current_chain"), "hop_count", "loop")
    own = recommended.where("action <> 'no_action'").join(chain, key, "left")
    return own.withColumns({"hop_count": F.coalesce("hop_count", F.lit(0)), "loop": F.coalesce("loop", F.lit(False))})
