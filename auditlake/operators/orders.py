"""The total orders of result tables: sequences without one task, and keyset pages in any order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.metadata import RANK_SQL
from auditlake.operators.ordering import indexed
from auditlake.operators.resultset import MAX_PAGE

#: Columns of each order; '-' before a name: falling. severity_rank is computed from severity. Fixed values.
ORDERS: dict[str, tuple[str, ...]] = {
    "history_jobs": ("-submitted_sequence", "-job_id"),
    "history_runs": ("-submitted_sequence", "-run_id"),
    "image_audits": ("-created_at", "-audit_id"),
    "image_resources": ("resource_sequence", "resource_id"),
    "image_occurrences": ("occurrence_sequence", "analysis_id"),
    "image_pages": ("page_sequence", "page_summary_id"),
    "image_groups": ("group_sequence", "group_id"),
    "image_findings": ("finding_sequence", "finding_id"),
    "image_recommendations": ("recommendation_sequence", "recommendation_id"),
    "internal_pages": ("page_sequence", "page_identity"),
    "internal_edges": ("edge_sequence", "edge_id"),
    "internal_findings": ("finding_sequence",),
    "internal_anchors": ("anchor_sequence",),
    "internal_opportunities": ("opportunity_sequence",),
    "internal_audits": ("-created_at", "-audit_id"),
    "link_targets": ("target_sequence", "target_identity"),
    "link_occurrences": ("source_discovery_sequence", "link_sequence"),
    "link_chains": ("chain_sequence", "chain_identity"),
    "link_findings": ("finding_sequence",),
    "link_recommendations": ("recommendation_sequence",),
    "link_audits": ("-created_at", "-audit_id"),
    "metadata_audits": ("-created_at", "-audit_id"),
    "metadata_pages": ("-severity_rank", "url_identity"),
    "metadata_issues": ("-severity_rank", "category", "code", "url_identity"),
    "metadata_duplicates": ("-member_count", "group_id"),
    "page_evidence": ("crawl_discovery_sequence", "url_identity"),
    "sitemap_audits": ("-created_at", "-audit_id"),
    "sitemap_documents": ("discovery_sequence", "document_id"),
    "sitemap_entries": ("document_sequence", "entry_sequence", "entry_id"),
    "sitemap_findings": ("finding_sequence", "finding_id"),
    "sitemap_comparisons": ("action", "sequence", "url_identity"),
}


@dataclass(frozen=True)
class Key:
    """A column of an order and its direction; nulls come last either way."""

    name: str
    falling: bool

    def sort(self) -> Column:
        return F.desc_nulls_last(self.name) if self.falling else F.asc_nulls_last(self.name)

    def beyond(self, value: object) -> Column:
        """Rows that come later than a value; none comes later than null."""
        if value is None:
            return F.lit(False)
        c = F.col(self.name)
        return F.coalesce(c < F.lit(value) if self.falling else c > F.lit(value), F.lit(True))

    def within(self, value: object) -> Column:
        """Rows that don't come earlier: a bound that a scan can use where nulls aren't wanted."""
        c = F.col(self.name)
        return c.isNull() if value is None else (c.isNull() | (c <= F.lit(value) if self.falling else c >= F.lit(value)))


def keys(order: str | Sequence[str]) -> list[Key]:
    """A registered order by name, or columns with '-' for falling ones."""
    return [Key(c.removeprefix("-"), c.startswith("-")) for c in (ORDERS[order] if isinstance(order, str) else order)]


def ranked(rows: DataFrame) -> DataFrame:
    """rows with severity_rank, where they have a severity and no rank."""
    return rows.withColumn("severity_rank", F.expr(RANK_SQL)) if "severity" in rows.columns and "severity_rank" not in rows.columns else rows


def sequenced(rows: DataFrame, order: str | Sequence[str], name: str = "sequence", group: Sequence[str] = ()) -> DataFrame:
    """rows with their places from 0 in an order, within each group: ranges are sorted apart and count on from each other.

    Rows that agree in all columns of the order may change places. No task sees more than a range.
    """
    own = ranked(rows)
    placed = indexed(own, [k.sort() for k in keys(order)], group, name)
    return placed if "severity_rank" in rows.columns else placed.drop("severity_rank")


def page(rows: DataFrame, order: str | Sequence[str], after: Sequence[object] | None, size: int) -> DataFrame:
    """The `size` rows that follow a key (one value for each column, null allowed) in an order: a filter and a top-k."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError("page size is out of range")
    own, by = ranked(rows), keys(order)
    if after is not None:
        if len(after) != len(by):
            raise ValueError("the key has other columns than the order")
        later = F.lit(False)
        for key, value in reversed(list(zip(by, after, strict=True))):
            later = key.beyond(value) | (F.col(key.name).eqNullSafe(F.lit(value)) & later)
        own = own.where(by[0].within(after[0]) & later)
    out = own.orderBy(*(k.sort() for k in by)).limit(size)
    return out if "severity_rank" in rows.columns else out.drop("severity_rank")
