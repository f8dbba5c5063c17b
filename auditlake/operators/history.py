"""History of jobs and runs: filters, time ranges, existence of related rows, pages from the newest back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.orders import page
from auditlake.operators.reads import TERMINAL

#: How a job's failure shows that it was interrupted, and what artifacts can be fetched. Fixed values.
INTERRUPTED_CODES = ("process_restart_interrupted", "stale_lease_recovered")
DOWNLOADABLE = ("available", "retained")


@dataclass(frozen=True)
class Filters:
    """equal: column -> value. since, before: column -> bound (both inclusive). exists: name of a related frame -> wanted or not.
    positive: counter column -> above zero or zero."""

    equal: Mapping[str, object] = field(default_factory=dict)
    since: Mapping[str, object] = field(default_factory=dict)
    before: Mapping[str, object] = field(default_factory=dict)
    exists: Mapping[str, bool] = field(default_factory=dict)
    positive: Mapping[str, bool] = field(default_factory=dict)


def current_jobs(jobs: DataFrame) -> DataFrame:
    """Each run's job with the highest created_sequence: one aggregation, no window over a run's jobs."""
    others = [c for c in jobs.columns if c != "run_id"]
    return jobs.groupBy("run_id").agg(F.max_by(F.struct(*others), "created_sequence").alias("j")).select("run_id", *(F.col(f"j.{c}").alias(c) for c in others))


def history(rows: DataFrame, filters: Filters, related: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """rows that meet all filters. related: name -> (frame, key column that rows also have); only its keys are read.

    A bound leaves out rows without a time. Unknown columns and frames are errors.
    """
    related = related or {}
    for c in (*filters.equal, *filters.since, *filters.before, *filters.positive):
        if c not in rows.columns:
            raise ValueError(f"unknown filter: {c}")
    for c, v in filters.equal.items():
        rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
    for c, v in filters.since.items():
        rows = rows.where(F.col(c) >= F.lit(v))
    for c, v in filters.before.items():
        rows = rows.where(F.col(c) <= F.lit(v))
    for c, some in filters.positive.items():
        rows = rows.where(F.col(c) > 0 if some else F.col(c) == 0)
    for name, wanted in filters.exists.items():
        if name not in related:
            raise ValueError(f"unknown filter: {name}")
        frame, key = related[name]
        rows = rows.join(frame.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi" if wanted else "left_anti")
    return rows


def history_page(rows: DataFrame, filters: Filters, order: str | Sequence[str], after: Sequence[object] | None = None, size: int = 50, related: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """A page of the history, after a key of the order (as orders.page)."""
    return page(history(rows, filters, related), order, after, size)


def runs_with_jobs(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """runs (run_id, lifecycle, terminal_at, ...) with their current job; runs without one are left out."""
    return runs.join(current_jobs(jobs), "run_id").withColumn("terminal", F.col("lifecycle").isin(*TERMINAL))
