"""Shards of nearly equal bytes by minimax contiguous partition.

Documents with equal texts are one atomic group. Groups stand in a line: large ones first, then the others, both by a hash
of the text, so that a shard is a mixture. The smallest capacity at which a greedy walk needs no more shards than there are
is found by binary search; the line is then cut at the group ends nearest to equal shares, within the cuts that the capacity
allows. The driver never holds the line: it knows the sums of at most CELLS ranges of hashes and walks over these with a
lower and an upper bound for each cut; ranges in which the bounds leave a cut open are split by a further job, until every
cut stands exactly between two groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut, fresh
from auditlake.operators.ordering import indexed

#: Bytes that a document takes besides its text.
OVERHEAD = 8
#: Bits of a group's key: the leading 60 bits of the text's SHA-256. Texts that share them would stay together as one group.
KEY_BITS = 60
#: A group above 1 / LARGE of all bytes is large: there are fewer than LARGE.
LARGE = 1 << 14
#: Ranges of keys that one job sums.
CELLS = 1 << 16


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, key: what sharding needs of each row; a null text counts as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), size_of(text).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_of(text).alias("key"))


def size_of(text: Column) -> Column:
    return F.octet_length(text).cast("long") + OVERHEAD


def key_of(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, KEY_BITS // 4), 16, 10).cast("long")


@dataclass
class Line:
    """What the driver knows of the line: a cell is one group, or all groups of a range of keys that aren't large."""

    cells: list[tuple[int, int, int, int, int]]  # first key, bits of the range, bytes, bytes of the largest group, groups
    large: list[tuple[int, int]]  # key and bytes of the large groups, in their order
    starts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.all = [(k, KEY_BITS, s, s, 1) for k, s in self.large] + sorted(self.cells)
        self.starts, at = [], 0
        for c in self.all:
            self.starts.append(at)
            at += c[2]
        self.bytes = at
        self.most = max((c[3] for c in self.all), default=0)

    def cell(self, x: int) -> int:
        return bisect_right(self.starts, x) - 1

    def floor(self, x: int) -> tuple[int, int]:
        """Bounds of the last group end that is at most x."""
        if x >= self.bytes:
            return self.bytes, self.bytes
        i = self.cell(x)
        start, (_, _, _, most, groups) = self.starts[i], self.all[i]
        return (start, start) if groups == 1 else (max(start, x - most + 1), x)

    def ceiling(self, x: int) -> tuple[int, int]:
        """Bounds of the first group end that is at least x."""
        if x <= 0:
            return 0, 0
        i = bisect_left(self.starts, x)  # the cell before it holds x - 1
        end = self.starts[i] if i < len(self.starts) else self.bytes
        _, _, _, most, groups = self.all[i - 1]
        return (end, end) if groups == 1 or end == x else (x, min(end, x + most - 1))

    def inside(self, low: int, high: int) -> list[int]:
        """The cells of several groups that the bounds leave open."""
        if low == high and (low >= self.bytes or self.starts[self.cell(low)] == low):
            return []
        first, last = self.cell(min(max(low, 0), self.bytes - 1)), self.cell(min(high, self.bytes - 1))
        return [i for i in range(first, last + 1) if self.all[i][4] > 1]


def least(low: int, high: int, holds) -> int:
    """The smallest number from low to high for which a condition that stays true holds; it does for high."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def walk(line: Line, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Bounds of the greedy cuts from the left: each shard takes groups while they fit."""
    out, low, high = [], 0, 0
    for _ in range(shards):
        low, high = line.floor(low + capacity)[0], line.floor(high + capacity)[1]
        out.append((low, high))
    return out


def smallest_capacity(line: Line, shards: int) -> tuple[int | None, set[int]]:
    """The smallest feasible capacity; where the cells leave it open None, and the cells to split."""
    low, high = max(line.most, -(-line.bytes // shards)), line.bytes
    may = least(low, high, lambda c: walk(line, c, shards)[-1][1] >= line.bytes)
    does = least(may, high, lambda c: walk(line, c, shards)[-1][0] >= line.bytes)
    if may == does:
        return may, set()
    spans = [(a[0], b[1]) for a, b in zip(walk(line, may, shards), walk(line, does, shards), strict=True)]
    return None, {i for a, b in spans for i in line.inside(a, b)}


def level_cuts(line: Line, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """The cuts nearest to equal shares at which no shard exceeds the capacity, or the cells to split for them."""
    least_cut, open_cells = [0] * shards + [line.bytes], set()
    low = high = line.bytes
    for j in range(shards - 1, 0, -1):  # the first ends from which the rest still fits
        low, high = line.ceiling(low - capacity)[0], line.ceiling(high - capacity)[1]
        if low != high:
            open_cells |= set(line.inside(low, high))
        least_cut[j] = high
    cuts = [0]
    for j in range(1, shards):
        aim = j * line.bytes // shards
        before, after = line.floor(aim), line.ceiling(aim)
        furthest = line.floor(cuts[-1] + capacity)
        for a, b in (before, after):
            if a != b:
                open_cells |= set(line.inside(a, b))
        near = before[0] if aim - before[0] <= after[1] - aim else after[1]
        if furthest[0] != furthest[1] and near > furthest[0]:
            open_cells |= set(line.inside(*furthest))
        cuts.append(min(max(near, least_cut[j], cuts[-1]), furthest[0]))
    return cuts + [line.bytes], open_cells


@dataclass
class Plan:
    """Shards by key: large groups have their own entry, for others the shard is first plus how many cut keys are at most the key."""

    shards: int
    capacity: int
    large: dict[int, int]
    cut_keys: list[int]
    first: int


def _sums(groups: DataFrame, bits: int) -> Iterable[tuple[int, int, int, int, int]]:
    shift = KEY_BITS - bits
    for r in groups.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("size"), F.max("size").alias("most"), F.count(F.lit(1)).alias("groups")).collect():
        yield r["cell"] << shift, bits, r["size"], r["most"], r["groups"]


def split(groups: DataFrame, line: Line, open_cells: set[int], cells: int) -> Line:
    """The line with the open cells in finer ranges: at most about `cells` more."""
    chosen = [line.all[i] for i in sorted(open_cells)]
    spans: list[list[int]] = []
    for first, bits, *_ in chosen:
        end = first + (1 << (KEY_BITS - bits))
        if spans and spans[-1][1] == first:
            spans[-1][1] = end
        else:
            spans.append([first, end])
    width = sum(b - a for a, b in spans)
    bits = min(KEY_BITS, max(max(c[1] for c in chosen) + 1, KEY_BITS - (width // cells).bit_length()))
    within = F.lit(False)
    for a, b in spans:
        within = within | F.col("key").between(a, b - 1)
    gone = set(chosen)
    return Line([c for c in line.cells if c not in gone] + list(_sums(groups.where(within), bits)), line.large)


def plan(groups: DataFrame, shards: int, large: int = LARGE, cells: int = CELLS) -> Plan:
    """The shards of a written table of groups (key, size), each key once.

    A group that is no smaller than the mean of what is left gets a shard of its own, the largest first: no cut makes its shard
    smaller. The others are the line. No group: everything goes to shard 0.
    """
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()["s"]
    known = sorted(((r["key"], r["size"]) for r in groups.where(F.col("size") * large > total).select("key", "size").collect()), key=lambda g: (-g[1], g[0]))
    own, rest = {}, total
    while known and len(own) < shards - 1 and known[0][1] * (shards - len(own)) >= rest:
        key, size = known.pop(0)
        own[key] = len(own)
        rest -= size
    first = len(own)
    left = shards - first
    small = groups.where(F.col("size") * large <= total)
    line = Line(list(_sums(small, min(KEY_BITS, cells.bit_length() - 1))) if rest else [], sorted(known))
    if not rest:
        return Plan(shards, max((0, *(s for _, s in known))), own, [], min(first, shards - 1))
    while True:
        capacity, open_cells = smallest_capacity(line, left)
        if capacity is not None:
            cuts, open_cells = level_cuts(line, capacity, left)
            if not open_cells:
                break
        line = split(small, line, open_cells, cells)
    n, keys = len(line.large), []
    for j, at in enumerate(cuts[1:-1], 1):
        i = bisect_left(line.starts, at)
        if i >= n:
            keys.append(line.all[i][0] if i < len(line.all) else 1 << KEY_BITS)
    for i, (key, _) in enumerate(line.large):
        own[key] = first + bisect_right(cuts[1:-1], line.starts[i])
    # Cuts among the large groups come before every other key.
    return Plan(shards, capacity, own, keys, shards - 1 - len(keys))


def with_shard(rows: DataFrame, made: Plan, key: str, name: str) -> DataFrame:
    """rows with the shard of their key: a broadcast of fewer than LARGE groups, and a comparison with each cut."""
    shard = F.lit(made.first)
    for k in made.cut_keys:
        shard = shard + (F.col(f"`{key}`") >= k).cast("int")
    if not made.large:
        return rows.withColumn(name, shard.cast("int"))
    k, s = fresh(rows, "large_key", "large_shard")
    table = rows.sparkSession.createDataFrame(list(made.large.items()), f"`{k}` long, `{s}` int")
    joined = rows.join(F.broadcast(table), F.col(f"`{key}`") == F.col(k), "left")
    return joined.withColumn(name, F.coalesce(s, shard).cast("int")).drop(k, s)


def grouped(rows: DataFrame) -> DataFrame:
    """key, size of each group of rows that measured() made, written."""
    return cut(rows.groupBy("key").agg(F.sum("size").alias("size")), "shard-groups")


def shard_rows(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row of docs.

    size: bytes of the text (null: none) and OVERHEAD. No shard's bytes exceed the smallest capacity that the line of groups
    allows; documents of equal text share a shard, null and empty texts too. slot: place in the shard, without gaps, by the
    text's key and the id. Repeated rows are separate rows, which may change slots among themselves; null ids come first.
    An empty table gives an empty result; with fewer groups than shards some shards stay empty. Other columns aren't read.
    """
    rows = cut(measured(docs, id_col, text_col), "shard-rows")
    placed = indexed(with_shard(rows, plan(grouped(rows), shards), "key", "shard"), ["key", "doc_id"], ["shard"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 24, text_col: str = "text", name: str = "shard") -> DataFrame:
    """docs with their own columns and the shard of each row, for writing: texts are read a second time and not shuffled.

    `name` must not be a column of docs. Nulls and empty tables as in shard_rows.
    """
    rows = cut(measured(docs, text_col, text_col).select("size", "key"), "shard-rows")
    key, = fresh(docs, "shard_key")
    own = docs.withColumn(key, key_of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return with_shard(own, plan(grouped(rows), shards), key, name).drop(key)


def write_shards(docs: DataFrame, path: str, shards: int = 24, text_col: str = "text", name: str = "shard") -> None:
    """Parquet files below path/shard=0, ...: what sharded() gives, each shard in as many files as tasks that have rows of it."""
    sharded(docs, shards, text_col, name).write.partitionBy(name).parquet(path)
