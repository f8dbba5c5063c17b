"""Greedy segments of an ordered table, cut in parallel.

A segment takes rows in order while it has room in rows and in bytes. Where a segment starts depends on all rows before, yet a
range of the order turns one start into another by itself: its map gives, for each place at which a segment may start there,
where the first segment of the next range starts and how many segments lie between. Maps of neighbours compose, so they are
joined level by level, the starts handed down again, and every range cuts its own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.shared import written

#: Rows of a range, and maps that one step composes.
RANGE, FAN_IN = 1 << 17, 64
MAP = "place long, starts binary, counts binary"


def next_starts(sizes: np.ndarray, most: int, capacity: int) -> np.ndarray:
    """For each row the row at which the following segment starts if one starts here. Every row must fit by itself."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return np.minimum(np.arange(len(sizes)) + most, np.searchsorted(upto, upto[:-1] + capacity, side="right") - 1)


def jumps(following: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start before `end` the first start at or after it, and the segments up to there, by pointer jumping."""
    to, n = following.copy(), np.ones(len(following), np.int64)
    while True:
        inside = np.flatnonzero(to < end)
        if not len(inside):
            return to, n
        n[inside], to[inside] = n[inside] + n[to[inside]], to[to[inside]]


def segmented(rows: DataFrame, most: int, capacity: int, range_rows: int = RANGE, fan_in: int = FAN_IN) -> DataFrame:
    """rows (index from 0 without gaps, bytes) with segment (from 0): at most `most` rows and `capacity` bytes in each.

    No row may have more bytes than `capacity`: leave such rows out first. A task sees one range and the `most` rows behind it; a
    map has most + 1 places at most. No rows give no rows.
    """
    size = max(range_rows, most)
    place = F.expr(f"index div {size}")
    # A range also reads the rows that its last segment may reach.
    reach = rows.withColumn("place", F.explode(F.when((F.col("index") % size < most) & (F.col("index") >= size), F.array(place, place - 1)).otherwise(F.array(place))))

    def mapped(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        at = int(part["place"].iloc[0])
        following = next_starts(part["bytes"].to_numpy(), most, capacity)
        own = min(size, len(part))
        to, n = jumps(following[:own], own)
        # Starts beyond the range are handed on as they are.
        starts, counts = np.concatenate([to, np.arange(own, most + 1)])[: most + 1], np.concatenate([n, np.zeros(max(0, most + 1 - own), np.int64)])[: most + 1]
        # A range that is not full is the last one: nothing starts behind it.
        return pd.DataFrame({"place": [at], "starts": [(starts - size).astype(np.int64).tobytes()], "counts": [counts.tobytes()]})

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        starts, counts = np.arange(most + 1), np.zeros(most + 1, np.int64)
        for s, c in zip(part["starts"], part["counts"], strict=True):
            s, c = np.frombuffer(s, np.int64), np.frombuffer(c, np.int64)
            alive = (starts >= 0) & (starts < len(s))
            counts[alive] += c[starts[alive]]
            starts[alive] = s[starts[alive]]
        return pd.DataFrame({"place": [int(part["place"].iloc[0]) // fan_in], "starts": [starts.tobytes()], "counts": [counts.tobytes()]})

    levels = [written(reach.select("place", "index", "bytes").groupBy("place").applyInPandas(mapped, MAP), "segment-maps")]
    while levels[-1].select("place").limit(2).count() > 1:
        levels.append(written(levels[-1].withColumn("block", F.expr(f"place div {fan_in}")).groupBy("block").applyInPandas(lambda p: composed(p.drop(columns="block")), MAP), "segment-maps"))

    def handed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        start, before, out = int(part["start"].iloc[0]), int(part["before"].iloc[0]), []
        for p, s, c in zip(part["place"], part["starts"], part["counts"], strict=True):
            out.append((int(p), start, before))
            s, c = np.frombuffer(s, np.int64), np.frombuffer(c, np.int64)
            if 0 <= start < len(s):
                start, before = int(s[start]), before + int(c[start])
        return pd.DataFrame(out, columns=["place", "start", "before"])

    starts = levels[-1].select("place", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("before"))
    for below in reversed(levels[:-1]):
        held = below.withColumn("block", F.expr(f"place div {fan_in}")).join(starts.withColumnRenamed("place", "block"), "block")
        starts = written(held.groupBy("block").applyInPandas(lambda p: handed(p.drop(columns="block")), "place long, start long, before long"), "segment-starts")

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        at, before = int(part["start"].iloc[0]), int(part["before"].iloc[0])
        following, heads = next_starts(part["bytes"].to_numpy(), most, capacity), []
        while at < len(part):
            heads.append(at)
            at = int(following[at])
        return pd.DataFrame({"index": part["index"], "segment": before - 1 + np.searchsorted(heads, np.arange(len(part)), side="right")})

    own = rows.select("index", "bytes", place.alias("place")).join(starts, "place").groupBy("place").applyInPandas(cut, "index long, segment long")
    return rows.join(own, "index")
