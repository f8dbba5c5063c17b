"""Reading of results: named resources with fixed filters, sorts and a total order; totals, run candidates, run gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.resultset import filtered, latest, offset_page


@dataclass(frozen=True)
class Resource:
    """Filters (as of resultset.filtered) and sort columns that readers may name, and the columns that make the order total."""

    filters: tuple[str, ...]
    sorts: tuple[str, ...]
    order: tuple[str, ...]


RESOURCES = {
    "page_evidence": Resource(
        ("http_status", "class_http_status", "fetch_failed", "category", "parsed_as_html", "has_title", "has_final_url", "title_presence", "canonical_presence", "evidence_state", "in_scope", "contains_url"),
        ("page_id", "http_status", "title_length"), ("page_id",),
    ),
    "recommendations": Resource(("state", "primary_reason", "contains_reasons"), ("page_id", "state"), ("page_id",)),
    "link_targets": Resource(
        ("broken_state", "redirect_state", "severity", "action", "confidence", "sitewide", "class_http_status", "min_source_pages", "min_hop_count"),
        ("source_pages", "occurrences", "hop_count"), ("target_page",),
    ),
    "link_occurrences": Resource(("link_type", "nofollow", "contains_href", "contains_anchor"), ("page_id",), ("page_id", "link_sequence")),
    "internal_pages": Resource(
        ("eligibility", "primary_state", "orphan_state", "hub", "authority", "min_inbound", "max_inbound", "min_outbound", "max_outbound", "min_distance", "max_distance"),
        ("inbound", "outbound", "distance"), ("page_id",),
    ),
    "internal_edges": Resource(("edge_state", "sitewide", "min_occurrences", "min_nofollows"), ("occurrences",), ("source", "target")),
    "image_occurrences": Resource(
        ("alt_state", "dimension_state", "loading_state", "resource", "severity", "reason", "action", "contains_src", "min_reuse"), ("reuse", "page_id"), ("page_id", "index")
    ),
    "structured_findings": Resource(("code", "severity", "page_id"), ("page_id",), ("page_id", "index", "code")),
    "migration_findings": Resource(("code", "category", "severity", "action", "confidence", "contains_source_url", "contains_destination_url"), ("source_url", "code"), ("source_url", "destination_url", "code")),
    "sitemap_comparisons": Resource(("present", "recommendation", "state", "action", "reason"), ("state",), ("key",)),
    "combined_urls": Resource(
        ("recommendation", "sitemap_state", "http_status", "class_http_status", "category", "fetch_failed", "parsed_as_html", "canonical_presence", "indexability_state", "evidence_state", "in_sitemap", "contains_url"),
        ("page_id", "url", "http_status", "recommendation", "sitemap_state", "redirect_count"), ("page_id",),
    ),
    "history": Resource(("run_id", "state", "lifecycle", "min_terminal_at", "max_terminal_at", "has_terminal_at"), ("terminal_at",), ("run_id",)),
}


def read(resource: str, rows: DataFrame, filters: dict[str, object] | None = None, sort: str | None = None, descending: bool = False, offset: int = 0, size: int = 50) -> DataFrame:
    """One page of a resource in a total order; a filter or sort that the resource doesn't list is an error.

    Nulls come last in either direction, and the resource's own order breaks ties.
    """
    own = RESOURCES[resource]
    if sort is not None and sort not in own.sorts:
        raise ValueError(f"unknown sort: {sort}")
    first = [] if sort is None else [F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)]
    return offset_page(filtered(rows, filters or {}, set(own.filters)), [*first, *(F.asc_nulls_last(c) for c in own.order)], offset, size)


def totals(rows: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """One row of counts, a column for each condition (SQL), in one pass."""
    return rows.agg(*(F.count(F.when(F.expr(sql), 1)).alias(name) for name, sql in conditions.items()))


def evidence_scan(rows: DataFrame, run: str, version: int, order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """The rows of one run in order (columns run_id, version); rows of any other version are an error."""
    own = rows.where(F.col("run_id") == run)
    if not own.where(~F.col("version").eqNullSafe(F.lit(version))).isEmpty():
        raise ValueError(f"run {run} has evidence of another version than {version}")
    return own.orderBy(*order)


TERMINAL = ("completed", "completed_with_warnings", "partially_completed", "failed", "cancelled")


def run_candidates(runs: DataFrame, jobs: DataFrame, summaries: DataFrame, most_pages: int) -> DataFrame:
    """run_id, job_id, terminal_at, evidence_count, evidence_state, eligible, reason of each run that has a job.

    runs: run_id, lifecycle, terminal_at. jobs: run_id, job_id, sequence; the last one counts. summaries: run_id,
    total_records, retention_state, incomplete_records (partial, failed or truncated). Read newest first by
    terminal_at, then job sequence, then run_id.
    """
    own = runs.join(latest(jobs, ["run_id"], [F.desc("sequence")]), "run_id").join(summaries, "run_id", "left")
    count = F.coalesce("total_records", F.lit(0))
    reasons = (
        (~F.col("lifecycle").isin(*TERMINAL), "not_terminal"), (count == 0, "no_evidence"), (F.col("retention_state") != "retained", "not_retained"), (count > most_pages, "too_many_pages"),
    )
    reason = F.coalesce(*(F.when(test, F.lit(name)) for test, name in reasons))
    state = F.when(count == 0, "unavailable").when(F.col("incomplete_records") > 0, "partial").otherwise("complete")
    return own.select("run_id", "job_id", "sequence", "terminal_at", count.alias("evidence_count"), state.alias("evidence_state"), reason.isNull().alias("eligible"), reason.alias("reason"))


def run_gate(runs: DataFrame, evidence: dict[str, DataFrame], scopes: DataFrame) -> DataFrame:
    """run_id, terminal, n_<kind> of each kind of evidence, scope_available, compatible: what an audit asks of a run.

    Every frame has run_id; evidence is counted before it meets the runs.
    """
    own = runs.select("run_id", F.col("lifecycle").isin(*TERMINAL).alias("terminal"))
    for kind, rows in evidence.items():
        own = own.join(rows.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"n_{kind}")), "run_id", "left").fillna(0, [f"n_{kind}"])
    own = own.join(scopes.select("run_id", F.lit(True).alias("scope_available")).distinct(), "run_id", "left").fillna(False, ["scope_available"])
    ready = F.col("terminal") & F.col("scope_available")
    for kind in evidence:
        ready = ready & (F.col(f"n_{kind}") > 0)
    return own.withColumn("compatible", ready)
