"""Places in a total order without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.shared import written

#: Rows of a range, on average, where the session's shuffle partitions would make larger ones.
RANGE_ROWS = 500_000


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ranges_for(df: DataFrame) -> int:
    """How many ranges a written table is dealt to."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // RANGE_ROWS))


def indexed(df: DataFrame, order: Sequence[str | Column], group: Sequence[str] = (), name: str = "index", total: str | None = None) -> DataFrame:
    """df with `name`, the place (long, from 0, without gaps) of each row of a group in the order; total: also the group's rows.

    Rows are dealt to ranges of (group, order), counted for each range, and numbered inside a range after the rows of the
    ranges before it: a group may hold all rows. Rows that agree in group and order may change places; they may fall in
    different ranges, so many of them are no hot key. Groups may be null. df is read twice (bounds, rows) and should be a
    written table or cheap; the ranges are written once. An empty table gives an empty one.
    """
    part, start, size, upto, all_ = free(df, "part", "start", "rows_of", "part_of", "rows_all")
    keys = [f"`{g}`" for g in group]
    ranged = df.repartitionByRange(ranges_for(df), *(F.col(k) for k in keys), *order, F.monotonically_increasing_id())
    ranged = written(ranged.withColumn(part, F.spark_partition_id()), "ranges")
    inside = Window.partitionBy(*(F.col(k) for k in keys)) if keys else Window.partitionBy(F.lit(0))
    counts = ranged.groupBy(*(F.col(k) for k in keys), part).agg(F.count(F.lit(1)).alias(size))
    before = F.sum(size).over(inside.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({start: F.coalesce(before, F.lit(0)), all_: F.sum(size).over(inside)})
    # A row for each range and group: no more than ranges plus groups, as ranges follow the groups' order.
    own = counts.select(*(F.col(k).alias(f"{upto}{i}") for i, k in enumerate(keys)), F.col(part).alias(upto), start, all_)
    same = F.col(part) == F.col(upto)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{upto}{i}"))
    rank = F.row_number().over(Window.partitionBy(*(F.col(k) for k in keys), part).orderBy(*order))
    placed = ranged.withColumn(size, rank).join(own, same)
    more = {} if total is None else {total: F.col(all_)}
    return placed.withColumns({name: F.col(start) + F.col(size) - 1} | more).drop(part, start, size, upto, all_, *(f"{upto}{i}" for i in range(len(keys))))
