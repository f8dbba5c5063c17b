"""Mixing sources to target weights by entropy balancing.

Rates are as near to 1 as the constraints let them, in the sense of the token-weighted relative entropy
sum(size * (r * log r - r)) under 0 <= r <= cap. The dual has one multiplier for each constraint (a value of a
margin, whose documents must yield a number of tokens); the solution is the exponential tilt r = min(cap, exp(sum of
the document's multipliers)). Newton's method maximises the dual. With one margin the dual falls apart into one problem
for each source, and the iterations run where the source's token sum is, in its row; with several margins each iteration
is one aggregation over cells, the distinct combinations of margin values with their token sums. Rates become whole copies
by error diffusion over the sizes of a source, from the largest to the smallest, kept to what the smaller documents can
still make good, so that the tokens taken stay within a small document's size of what the rates ask.

Documents are told apart by id and text, never by their place in a table, so the mix doesn't depend on partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import claim, cut, fresh, slices, text_bytes

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix for each word of the input.
SHARE = 1.5
#: Most copies of a document, and most of a source's size that a target may ask.
CAP = 2.0
#: Documents of one source and size that are ranked together; where there are more they are dealt into parts.
PART_ROWS = 500_000
#: Newton steps of a source's multiplier; a step is at most 1 downwards, so rates down to 1e-25 are met.
STEPS = 60


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, hash (of the text), source, size, key (source as a string that is never null); written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("entropy_mix")
        for b in slices(batches):
            own = text_bytes(b.column(2))
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in own], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(hashes), pa.array([len(t.split()) for t in own], pa.int64())], names=["doc_id", "source", "hash", "size"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return cut(own.mapInArrow(run, "doc_id long, source string, hash long, size long").withColumn("key", source_key("source")), "sizes")


def source_key(source: str):
    return F.when(F.col(source).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source).cast("string")))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size, target of each source (columns key, source_size); written to the shared folder.

    Shares are by weight, none above cap times the source's size, what is above is shared anew by weight. So a target is
    min(level * weight, cap * size) with one level for all, which rounds of sums find. Weights repeat in the order of the
    names by code point, null last; the places come from a range sort, not from one task.
    """
    placed = cut(sources.sort(F.col("key") == "", "key").withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range, as many as shuffle partitions.
    starts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("key") == "", "key")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (nth % len(weights) + 1).cast("int"))
    weighed = cut(placed.join(F.broadcast(starts), "range").withColumn("weight", weight).select("key", "source_size", "weight"), "weights")
    top = F.col("source_size") * F.lit(float(cap))
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > top
        got = weighed.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, top)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n")).first()
        if got["all"] is None or got["free"] is None or got["n"] == full:
            break
        full, level = got["n"], max(0.0, share * got["all"] - (got["full"] or 0.0)) / got["free"]
    target = F.least(F.col("weight") * F.lit(level), top) if level is not None else top
    return cut(weighed.select("key", "source_size", target.alias("target")), "targets")


def with_rates(targets: DataFrame, cap: float = CAP) -> DataFrame:
    """targets with the rate of each source: Newton steps of the dual of source_size * exp(multiplier) = target."""
    size, goal = F.col("source_size").cast("double"), F.col("target")

    def step(x, _):
        mass = size * F.exp(x)
        return x + F.greatest(F.least(goal / mass - 1, F.lit(2.0)), F.lit(-2.0))

    multiplier = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(0.0), step)
    rate = F.when((size == 0) | (goal <= 0), F.when(size == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.exp(multiplier), F.lit(float(cap))))
    return targets.withColumn("rate", F.round(rate, 12))


def solve_dual(cells: DataFrame, margins: list[str], goals: dict[tuple[str, str], float], cap: float = CAP, rounds: int = 60, tolerance: float = 1e-9) -> dict[tuple[str, str], float]:
    """Multipliers of the constraints goals[(margin, value)] = tokens over cells (margins, size); distributed Newton.

    The number of constraints is small (sources, languages); cells stay distributed. Goals must be attainable; what
    can't be met exactly is approached as far as the cap lets it.
    """
    names = [k for k, g in goals.items() if g > 0]
    at = {k: i for i, k in enumerate(names)}
    lam = np.zeros(len(names))
    goal = np.array([goals[k] for k in names])
    if not names:
        return {}

    def moments(lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        tilt = F.lit(0.0)
        for m in margins:
            own = [x for k, i in at.items() if k[0] == m for x in (F.lit(k[1]), F.lit(float(lam[i])))]
            if own:
                tilt = tilt + F.coalesce(F.try_element_at(F.create_map(*own), F.col(m)), F.lit(0.0))
        rate = F.least(F.exp(F.least(tilt, F.lit(50.0))), F.lit(cap))
        # The dual's value of a token: exp(t) below the cap, the tangent beyond it.
        value = F.when(tilt < math.log(cap), F.exp(F.least(tilt, F.lit(50.0)))).otherwise(F.lit(cap) * (tilt - math.log(cap) + 1))
        got = cells.select(*margins, "size", rate.alias("r"), value.alias("v"), (tilt < math.log(cap)).cast("double").alias("free"))
        got = got.groupBy(*margins).agg(F.sum(F.expr("size * r")).alias("t"), F.sum(F.expr("size * r * free")).alias("h"), F.sum(F.expr("size * v")).alias("v")).collect()
        first, second, total = np.zeros(len(names)), np.zeros((len(names), len(names))), 0.0
        for row in got:
            own = [at[k] for m in margins if (k := (m, row[m])) in at]
            total += row["v"]
            for i in own:
                first[i] += row["t"]
                for j in own:
                    second[i, j] += row["h"]
        return first, second, total

    first, second, total = moments(lam)
    for _ in range(rounds):
        gap = goal - first
        if np.all(np.abs(gap) <= tolerance * np.maximum(goal, 1)):
            break
        step = np.linalg.lstsq(second + 1e-12 * np.eye(len(names)) * max(1.0, second.max()), gap, rcond=None)[0]
        step = np.clip(step, -2, 2)
        scale, value = 1.0, total - goal @ lam
        for _ in range(30):
            new = moments(lam + scale * step)
            if new[2] - goal @ (lam + scale * step) <= value + 1e-12 * abs(value):
                break
            scale /= 2
        if scale * np.abs(step).max() < 1e-14:
            break
        lam = lam + scale * step
        first, second, total = new
    return dict(zip(names, lam.tolist(), strict=True))


def diffuse(cells: pd.DataFrame, cap: float = CAP) -> pd.DataFrame:
    """Whole copies for each size of one source: from the largest size down, the tokens owed carry on to the next.

    A size gets no more copies than the target has room for, and no fewer than leave a rest that smaller ones can take.
    """
    cells = cells.sort_values("size", ascending=False)
    most, owed, out = math.ceil(cap), 0.0, []
    room, smaller = float(cells["target"].iloc[0]), int((cells["size"] * cells["n"]).sum())
    for size, n, rate in zip(cells["size"].tolist(), cells["n"].tolist(), cells["rate"].tolist(), strict=True):
        if not size:
            out.append(n)
            continue
        owed += n * size * rate
        smaller -= n * size
        low, high = math.ceil((room - most * smaller) / size - 1e-9), math.floor(room / size + 1e-9)
        if low > high:  # the target is missed either way: by less
            low = high = high if room - high * size - most * smaller <= low * size - room else low
        copies = int(min(most * n, max(0, low, min(high, math.floor(owed / size + 1e-9)))))
        owed -= copies * size
        room -= copies * size
        out.append(copies)
    return cells.assign(copies=out)[["key", "size", "n", "copies", "source_size", "target"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, hash, source, size, source_size, target, copies, taken (size * copies), one row for each row of docs.

    A null text has size 0; null is a source of its own, the last. Documents of size 0 stay once. Repeated rows are
    separate documents, of which equal ones may change places. Null ids are allowed. Other columns are not read, so their
    names may clash. An empty table gives an empty result. Runs over the same rows agree, however they are partitioned.
    """
    sized = measure(docs, id_col, text_col, source_col)
    cells = cut(sized.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    sources = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    facts = with_rates(source_targets(sources, weights, share, cap), cap)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        return diffuse(rows, cap)

    # A group has a row for each different size, so at most as many as the longest text has words.
    dealt = cells.join(facts, "key").groupBy("key").applyInPandas(fold, "key string, size long, n long, copies long, source_size long, target double")
    # At most one row for each PART_ROWS documents.
    large = cells.where(F.col("n") > PART_ROWS).select("key", "size", F.ceil(F.col("n") / PART_ROWS).alias("parts"))
    own = sized.join(F.broadcast(large), ["key", "size"], "left")
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "hash"), F.coalesce("parts", F.lit(1)))).drop("parts")
    # Each part has its share of a size's copies, in whole numbers that add up.
    upto = F.sum("m").over(Window.partitionBy("key", "size").orderBy("part"))
    groups = own.groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("m")).join(dealt, ["key", "size"]).withColumn("upto", upto)
    groups = groups.withColumn("copies", F.expr("(copies * upto) div n - (copies * (upto - m)) div n")).select("key", "size", "part", "m", "copies", "source_size", "target")
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("doc_id", "hash"))
    each = F.expr("copies div m + cast(rank <= copies % m as int)").cast("int")
    ranked = own.withColumn("rank", rank).join(groups, ["key", "size", "part"]).withColumn("copies", each)
    return ranked.select("doc_id", "hash", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns, whatever their names.

    Rows of equal id, source and text may change places. Null texts and ids count as in mix; texts without words stay
    once. An empty table gives an empty result.
    """
    names = docs.columns
    at, at_id, at_source = fresh(docs, "hash", "id", "key")
    nth, copies, copy = fresh(docs.select("*", F.lit(0).alias(at), F.lit(0).alias(at_id), F.lit(0).alias(at_source)), "nth", "copies", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hashes = np.array([xxhash.xxh64_intdigest(t) for t in text_bytes(b.column(names.index(text_col)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes)], names=[*names, at])

    by = [at_id, at_source, at]
    own = docs.mapInArrow(run, docs.withColumn(at, F.lit(0).cast("long")).schema)
    own = own.withColumns({at_id: F.coalesce(F.col(id_col).cast("string"), F.lit("null")), at_source: source_key(source_col)})
    own = own.withColumn(nth, F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0))))
    plan = mix(docs, id_col, text_col, source_col, weights, share, cap).where("copies > 0")
    plan = plan.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(at_id), source_key("source").alias(at_source), F.col("hash").alias(at), F.col("copies").alias(copies))
    plan = plan.withColumn(nth, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(copies))))
    return own.join(plan, [*by, nth]).withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in names))
