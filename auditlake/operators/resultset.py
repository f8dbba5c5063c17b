"""The query surface of result tables: filters, sorts, keyset and offset pages, latest of a key, semi and anti filters."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_PAGE = 500


def filtered(df: DataFrame, filters: dict[str, object], allowed: set[str] | None = None) -> DataFrame:
    """Rows that meet all filters. Keys: column, min_column, max_column, contains_column (ignoring case), has_column, class_column (3 for 300-399)."""
    for key, value in sorted(filters.items()):
        if allowed is not None and key not in allowed:
            raise ValueError(f"unknown filter: {key}")
        kind, _, name = key.partition("_")
        if key in df.columns:
            df = df.where(F.col(key).eqNullSafe(F.lit(value)))
        elif kind == "min" and name in df.columns:
            df = df.where(F.col(name) >= value)
        elif kind == "max" and name in df.columns:
            df = df.where(F.col(name) <= value)
        elif kind == "contains" and name in df.columns:
            df = df.where(F.contains(F.lower(name), F.lit(str(value).lower())))
        elif kind == "has" and name in df.columns:
            df = df.where(F.col(name).isNotNull() if value else F.col(name).isNull())
        elif kind == "class" and name in df.columns:
            df = df.where(F.col(name).between(100 * int(value), 100 * int(value) + 99))
        else:
            raise ValueError(f"unknown filter: {key}")
    return df


def any_field_contains(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in df.columns))), F.lit(text.lower())))


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int) -> DataFrame:
    """The `size` rows after a key in a total order: a filter and a top-k, never a sort of everything before."""
    if not 1 <= size <= MAX_PAGE:
        raise ValueError("page size is out of range")
    if after is not None:
        # Written out, so that the first column's bound reaches the scan.
        more = F.lit(False)
        for name, value in reversed(list(zip(order, after, strict=True))):
            more = (F.col(name) > value) | ((F.col(name) == value) & more)
        df = df.where((F.col(order[0]) >= after[0]) & more)
    return df.orderBy(*order).limit(size)


def offset_page(df: DataFrame, order: list[Column | str], offset: int, size: int) -> DataFrame:
    if not 1 <= size <= MAX_PAGE or offset < 0:
        raise ValueError("page is out of range")
    return df.orderBy(*order).offset(offset).limit(size)


def cursor(filters: dict[str, object], position: int) -> str:
    """A cursor that only serves the filters it was made for."""
    tied = hashlib.sha256(json.dumps(filters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(json.dumps([tied, position]).encode()).decode().rstrip("=")


def cursor_position(value: str, filters: dict[str, object]) -> int:
    tied, position = json.loads(base64.urlsafe_b64decode(value + "=" * (-len(value) % 4)))
    if cursor(filters, position) != value or tied is None:
        raise ValueError("the cursor belongs to other filters")
    return int(position)


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__place = 1").drop("__place")


def capped(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """At most so many rows, and whether there were more."""
    return df.limit(most), df.limit(most + 1).count() > most


def reconciled(counts: DataFrame, rows: DataFrame, key: str, stored: str) -> DataFrame:
    """key, stored, actual where a stored count differs from the rows that there are."""
    actual = rows.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return counts.select(key, stored).join(actual, key, "full_outer").where(~F.coalesce(F.col(stored), F.lit(0)).eqNullSafe(F.coalesce("actual", F.lit(0))))


def retained(rows: DataFrame, expired: DataFrame, key: list[str]) -> DataFrame:
    """rows without those of expired keys."""
    return rows.join(expired.select(*key).distinct(), key, "left_anti")
