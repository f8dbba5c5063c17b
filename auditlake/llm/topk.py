"""Exact top-k inner products by tiled matrix products.

Vectors and queries are packed into blocks of rows, written once. Each partition of blocks of queries meets each partition
of blocks of vectors in one task (a cartesian product, so nothing is broadcast or dealt out in copies), where a block of
queries keeps its best k while the vectors pass as matrix products; a score counts only where it passes the query's k-th
best. Lists of a query are then merged level by level, each level joining a bounded number of lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import cut

#: Rows of a block of vectors and of a block of queries, and the bytes of a block as doubles that more rows may not pass.
BLOCK_ROWS, QUERY_ROWS, BLOCK_BYTES = 8192, 8192, 1 << 22
#: Queries and vectors of one matrix product: its scores stay in a core's cache.
PANEL_ROWS, PANEL_VECTORS = 512, 512
#: Lists of a query that one merge takes.
FAN_IN = 16
#: Bits below which sums of products are exact in singles and in doubles.
SINGLE, EXACT = 2.0**24, 2.0**53
#: Vectors no longer than this have inner products that doubles hold.
SHORT = 2.0**26
#: Components and scores beyond these are held at them.
LARGEST, LONG = 2.0**62, (1 << 63) - 1
#: Score of a place that nothing has taken.
NONE = -(1 << 63)


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, single, v: the usable vectors as bytes of singles, where the column has these, or doubles; rows with a null or non-finite component, or none, go."""
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    single = kind == "float"
    values = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64) + 0  # null: not a number; minus zero: zero
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fit = (bad[offsets[1:]] == bad[offsets[:-1]]) & (offsets[1:] > offsets[:-1])
            packed = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(lists), single)), packed], names=["vec_id", "single", "v"]).filter(pa.array(fit))

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).mapInArrow(run, "vec_id long, single boolean, v binary")


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """Usable vectors that can be among k best: of equal vectors those of the k + 1 smallest ids, as ties go to these and one of them may be the query's own."""
    order = Window.partitionBy("v", "single").orderBy("vec_id")
    return rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= k + 1).drop("nth").dropDuplicates(["vec_id", "v", "single"])


def blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """dim, ids, data: blocks of at most `size` vectors of equal length within a partition, by id; the values are floor(scale * x), of two bytes where these hold all, else doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            order = np.argsort(np.array(ids, np.int64), kind="stable")
            with np.errstate(over="ignore"):
                values = np.clip(np.floor(scale * np.stack(data).astype(np.float64)), -LARGEST, LARGEST)[order]
            if np.abs(values).max() < 1 << 15:
                values = values.astype(np.int16)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64)[order].tobytes()]), pa.array([values.tobytes()])], names=["dim", "ids", "data"])

        for b in batches:
            for i, single, v in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                part = np.frombuffer(v, np.float32 if single else np.float64)
                own = held.setdefault(len(part), ([], []))
                own[0].append(i)
                own[1].append(part)
                if len(own[0]) >= min(size, max(1, BLOCK_BYTES // (8 * len(part)))):
                    yield out(len(part))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, "dim int, ids binary, data binary")


def unpacked(ids: pa.Buffer, data: pa.Buffer, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a block."""
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(data, np.int16 if data.size == 2 * dim * len(i) else np.float64).reshape(-1, dim)


def whole(m: np.ndarray) -> np.ndarray:
    """Python integers in place of doubles with whole values, for sums that doubles can't hold."""
    return np.array([[int(x) for x in row] for row in m], object)


def tile(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """query, vec, score, place of the query in its block, of the k best rows of each query in one tile, ties to the smaller id; scores are exact."""
    (qi, q), (vi, v) = queries, rows
    bound = np.abs(q).sum(axis=1).max() * np.abs(v).max()
    exact = bound < EXACT
    scores = q @ v.T if exact else whole(q) @ whole(v).T
    order = np.argsort(vi, kind="stable")
    scores, vi = scores[:, order], vi[order]
    own = vi[None, :] == qi[:, None]
    out_q, out_v, out_s, out_p = [], [], [], []
    for i in range(len(qi)):
        s, ok = scores[i], ~own[i]
        at = np.flatnonzero(ok)
        if len(at) > k and exact:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= least]
        best = at[np.argsort(np.array([-x for x in s[at]], object if not exact else np.float64), kind="stable")][:k]
        out_q += [qi[i]] * len(best)
        out_v += vi[best].tolist()
        out_s += [int(x) for x in s[best]]
        out_p += [i] * len(best)
    return np.array(out_q, np.int64), np.array(out_v, np.int64), np.array(out_s, object), np.array(out_p, np.int32)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Lengths of vectors, a little more than they are."""
    x = rows.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x)) * 1.001


class Best:
    """The k best rows so far of each query of a block, ties to the smaller id; exact."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.ids, self.k, self.length = ids, k, lengths(rows)
        self.rows, self.singles = rows.astype(np.float64), rows.astype(np.float32)
        self.scores, self.vecs = np.full((len(ids), k), NONE, np.int64), np.zeros((len(ids), k), np.int64)

    def merge(self, at: np.ndarray, vecs: np.ndarray, scores: np.ndarray) -> None:
        """Takes in scores of the queries at these places."""
        if not len(at):
            return
        own, at = np.unique(at, return_inverse=True)
        old = np.repeat(np.arange(len(own)), self.k)
        at, vecs, scores = np.concatenate([old, at]), np.concatenate([self.vecs[own].ravel(), vecs]), np.concatenate([self.scores[own].ravel(), scores])
        order = np.lexsort((vecs, ~scores, at))
        at = at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.k
        to = own[at[kept]], rank[kept]
        self.scores[to], self.vecs[to] = scores[order][kept], vecs[order][kept]

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes in a block of vectors, by id."""
        length = lengths(rows)
        short, few = length < SHORT, self.length < SHORT
        if not (short.all() and few.all()):
            # Few vectors are that long: these alone leave the fast way.
            self.add_long(np.flatnonzero(few), ids[~short], rows[~short])
            self.add_long(np.flatnonzero(~few), ids, rows)
            ids, rows, length = ids[short], rows[short], length[short]
        if len(ids):
            asked = np.flatnonzero(few)
            singles, doubles = rows.astype(np.float32), None
            for a in range(0, len(asked), PANEL_ROWS):
                at = asked[a : a + PANEL_ROWS]
                at = slice(at[0], at[-1] + 1) if at[-1] - at[0] + 1 == len(at) else at
                single = bool(self.length[at].max() * length.max() < SINGLE)
                if not single and doubles is None:
                    doubles = rows.astype(np.float64)
                self.add_panel(at, ids, singles if single else doubles, (self.singles if single else self.rows)[at])

    def add_long(self, at: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for a in range(0, len(at) if len(ids) else 0, PANEL_ROWS):
            own = at[a : a + PANEL_ROWS]
            for c in range(0, len(ids), PANEL_VECTORS):
                _, vecs, scores, place = tile((self.ids[own], self.rows[own]), (ids[c : c + PANEL_VECTORS], rows[c : c + PANEL_VECTORS].astype(np.float64)), self.k)
                self.merge(own[place], vecs, np.array([max(-LONG, min(LONG, x)) for x in scores.tolist()], np.int64))

    def add_panel(self, at: slice | np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray) -> None:
        """The scores of some queries with all rows: those that pass the k-th best are merged."""
        mine, k, found = self.ids[at], self.k, []
        least, last = self.take(at, found)
        # One place in memory for all panels: fresh pages would cost as much as the products.
        room = np.empty(len(mine) * min(PANEL_VECTORS, len(ids)), rows.dtype)
        for c in range(0, len(ids), PANEL_VECTORS):
            own = ids[c : c + PANEL_VECTORS]
            scores = np.matmul(queries, rows[c : c + PANEL_VECTORS].T, out=room[: len(mine) * len(own)].reshape(len(mine), len(own)))
            # Where even the smallest id loses a tie, the k-th best has to be passed.
            floor = (least + (last < own[0])).astype(rows.dtype)
            up = np.flatnonzero(scores.max(axis=1) >= floor)
            if not len(up):
                continue
            scores, floor, asks = scores[up], floor[up], mine[up]
            hit = scores >= floor[:, None]
            if np.count_nonzero(hit) > 4 * k * len(up) and len(own) > k:
                low, high = np.searchsorted(own, asks), np.searchsorted(own, asks, "right")
                for i in np.flatnonzero(high > low):
                    scores[i, low[i] : high[i]] = -np.inf
                kth = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k].astype(np.float64)
                more = kth > least[up]
                least[up], last[up] = np.where(more, kth, least[up]), np.where(more, LONG, last[up])
                hit = scores >= np.maximum(floor, kth.astype(rows.dtype))[:, None]
            i, j = np.nonzero(hit)
            s, v, at_least, before = scores[i, j], own[j], least[up][i], last[up][i]
            kept = (v != asks[i]) & ((s > at_least) | (v < before) | (before == LONG))
            found.append((up[i[kept]], v[kept], s[kept].astype(np.int64)))
            if sum(len(x) for x, _, _ in found) > k * len(mine):
                least, last = self.take(at, found)
        self.take(at, found)

    def take(self, at: slice | np.ndarray, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Merges what was found, empties the list, and gives score and id of the k-th best."""
        if found:
            i, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
            self.merge(np.arange(len(self.ids))[at][i], v, s)
            found.clear()
        return self.scores[at, self.k - 1].astype(np.float64), self.vecs[at, self.k - 1].copy()

    def out(self, number: int, block: int) -> pa.RecordBatch:
        at, rank = np.nonzero(self.scores > NONE)
        names = ["list", "q_block", "place", "query_id", "vec_id", "score"]
        columns = [np.full(len(at), number, np.int32), np.full(len(at), block, np.int64), at.astype(np.int32), self.ids[at], self.vecs[at, rank], self.scores[at, rank]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of every query with every other row of vectors.

    Components become floor(scale * x), held at LARGEST; scores are whole numbers, held at the largest long where none holds
    them: within a tile they are ranked before that, between tiles such scores are ties. Ties go to the smaller vec_id. A
    query's own id is no candidate; with fewer than k candidates all are returned. Rows whose vector is null, empty or
    has a null or non-finite component, and rows with a null id, take no part. Vectors are compared with those of their
    length. Rows of equal id and equal vector count once; of rows that share an id, each vector is a candidate, and each
    query has a list of its own. Other columns are not read. Empty tables give an empty result.
    """
    plain = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}  # a partition takes as much memory as its bytes on disk
    data = cut(blocks(candidates(usable_vectors(vectors, id_col, vector_col), k), block_rows, scale), "vector-blocks", **plain)
    asked = cut(blocks(usable_vectors(queries, id_col, vector_col).dropDuplicates(["vec_id", "v"]), query_rows, scale).withColumn("q_block", F.monotonically_increasing_id()), "query-blocks", **plain)
    lists = max(1, data.rdd.getNumPartitions())
    asked = asked.select(F.col("dim").alias("q_dim"), "q_block", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    # Neither side is broadcast or shuffled, whatever its size: every task reads one partition of each from the written blocks.
    tiles = asked.join(data.withColumn("list", F.spark_partition_id()).hint("shuffle_replicate_nl"), F.col("q_dim") == F.col("dim"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        for b in batches:
            for r in range(b.num_rows):
                dim, number, block = (b.column(i)[r].as_py() for i in range(3))
                qi, q, vi, v = (b.column(i)[r].as_buffer() for i in range(3, 7))
                if at != (number, block):
                    if best:
                        yield best.out(*at)
                    at, best = (number, block), Best(*(x.copy() for x in unpacked(qi, q, dim)), k)
                best.add(*unpacked(vi, v, dim))
        if best:
            yield best.out(*at)

    best = tiles.select("dim", "list", "q_block", "q_ids", "q_data", "ids", "data").mapInArrow(run, "list int, q_block long, place int, query_id long, vec_id long, score long")
    while lists > 1:
        lists = -(-lists // FAN_IN)
        own = Window.partitionBy("q_block", "place", "list").orderBy(F.desc("score"), "vec_id")
        best = best.withColumn("list", F.expr(f"cast(list div {FAN_IN} as int)") if lists > 1 else F.lit(0)).withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).drop("rank")
    own = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

