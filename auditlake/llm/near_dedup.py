"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half keys are computed for each set, each of `halves` keys over `rows` minimum hashes. The
table keys are all pairs of a key of the first collection and a key of the second, so halves**2 tables cost only
2 * halves * rows hashes. A pair of similarity s shares a table unless one of the collections has no equal key: with
probability at most 2 * (1 - s**rows)**halves, which `halves_for` keeps under MISS at the threshold.

Half keys of the first collection which one set alone has are dropped before pairs of keys are formed. Members of a
bucket are verified against one member, and again, against another, after those found are one component; components are
contracted, so each round looks only at what new links join. What still shares a bucket with another component goes
through an exact prefix-filtered join, so no bucket is capped and no group's pairs are all emitted. Links are confirmed on
the full sets, which lie in files dealt by set: a verification moves one set for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import claim, cut, cut_by, fresh, keeps, slices, split_join, text_bytes
from auditlake.llm.components import merged_labels

#: Chance that a pair at the threshold shares no table.
MISS = 0.001
#: Minimum hashes of a half key.
ROWS = 3
#: Rounds in which buckets are compared with one member, another one each time.
STAR_ROUNDS = 3
#: Distinct words whose hashes a worker keeps.
MAX_WORDS = 500_000
#: Bits for each set to fetch in the bitmap of these, bits of its words, and most words: 16 MB. Beyond that more sets are fetched than
#: need be, and the result is the same.
BITS_EACH, ROUTE_BITS, MOST_WORDS = 16, 62, 1 << 21
#: Sets in a file of those fetched.
FILE_SETS = 20_000

#: Hashes of a set that are mapped at once.
BLOCK = 1 << 15

U = np.uint64
SEEDS = np.random.default_rng(20240607).integers(1, 2**63, size=512, dtype=np.uint64) * U(2) + U(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


WORD_HASHES = WordHashes()
keeps("near_dedup", WORD_HASHES.clear)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that mixes all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; a shorter sequence is one shingle, none is empty."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 7)], np.uint64)
    n, out = len(h) - words + 1, np.zeros(1, np.uint64)
    for i in range(words):
        out = spread(out + h[i : i + n])
    return np.unique(out)


def minima(values: np.ndarray, count: int) -> np.ndarray:
    """The smallest of each of count linear maps (odd factor, modulo 2**64) of the hashes, in blocks of bounded size."""
    a, b, out = SEEDS[:count, None], SEEDS[256 : 256 + count, None], np.full(count, ~U(0))
    for at in range(0, len(values), BLOCK):
        out = np.minimum(out, (values[None, at : at + BLOCK] * a + b).min(axis=1))
    return out


def halves_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    n = 1
    while 2 * (1 - similarity**rows) ** n > miss:
        n += 1
    return n


def signatures(docs: DataFrame, words: int, halves: int, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n (set size), set_hash, first, second (half keys), one row for each row of docs."""
    k = halves * rows

    def half_keys(m: np.ndarray) -> list[list[int]]:
        both = []
        for part in (m[:k], m[k:]):
            out = np.zeros(halves, np.uint64)
            for j in range(rows):
                out = spread(out + part[j::rows])
            both.append(out.view(np.int64).tolist())
        return both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup")
        for b in slices(batches):
            size, name, first, second = [], [], [], []
            for t in text_bytes(b.column(2)):
                s = shingles(t, words)
                size.append(len(s))
                name.append(xxhash.xxh128_digest(s.tobytes()))
                x, y = half_keys(minima(s, 2 * k)) if len(s) else (None, None)
                first.append(x)
                second.append(y)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(first, longs), pa.array(second, longs)], names=["doc_id", "row", "n", "set_hash", "first", "second"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return cut(own.mapInArrow(run, "doc_id long, row long, n long, set_hash binary, first array<long>, second array<long>"), "signatures")


def buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node: the tables' keys that more than one set has; nodes: node, first, second."""
    half = nodes.select("node", F.posexplode("first").alias("i", "half"))
    shared = half.groupBy("i", "half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    some = half.join(shared, ["i", "half"], "left_semi").join(nodes.select("node", "second"), "node")
    keys = some.select("node", "i", "half", F.posexplode("second").alias("j", "other")).select("node", F.xxhash64("i", "j", "half", "other").alias("bucket"))
    keys = cut(keys, "table-keys")
    full = keys.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("bucket")
    return cut(keys.join(full, "bucket", "left_semi").distinct(), "buckets")


def wanted_bits(ids: DataFrame, count: int) -> np.ndarray:
    """A bitmap, sized by their number, with a bit for each hash in ids (column h)."""
    size = min(MOST_WORDS, 1 << max(4, (BITS_EACH * count // ROUTE_BITS).bit_length()))
    words = ids.select(F.expr(f"cast(pmod(h div {ROUTE_BITS}, {size}) as int)").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {ROUTE_BITS}) as int))").alias("b")).groupBy("w").agg(F.expr("bit_or(b)").alias("b")).collect()
    out = np.zeros(size, np.uint64)
    for w, b in words:
        out[w] = b
    return out


def full_sets(docs: DataFrame, wanted: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """set_hash, shingles (sorted hashes as bytes) of at least the sets wanted (set_hash), from the texts; dealt by set_hash.

    Only texts whose set's bit is in the bitmap leave the scan, and copies of a set leave each task's batch once.
    """
    count = wanted.count()
    bits = wanted_bits(wanted.select(F.xxhash64("set_hash").alias("h")).select(F.expr("h & 4611686018427387903").alias("h")), count)
    names = docs.select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup")
        seen: set[bytes] = set()
        for b in slices(batches):
            keys, sets = [], []
            for t in text_bytes(b.column(0)):
                s = shingles(t, words).tobytes()
                key = xxhash.xxh128_digest(s)
                # Spark's xxhash64 of the key, with its seed.
                h = xxhash.xxh64_intdigest(key, 42) & 4611686018427387903
                if s and key not in seen and int(bits[(h // ROUTE_BITS) % len(bits)]) >> (h % ROUTE_BITS) & 1:
                    if len(seen) < 100_000:
                        seen.add(key)
                    keys.append(key)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["set_hash", "shingles"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // FILE_SETS))
    found = names.mapInArrow(run, "set_hash binary, shingles binary").repartition(parts, "set_hash").dropDuplicates(["set_hash"])
    return cut_by(found, "sets", "set_hash", parts)


def verified(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes (node, set_hash) whose sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, name: nodes.select(F.col("node").alias(node), F.col("set_hash").alias(name))
    named = pairs.join(side("a", "ha"), "a").join(side("b", "hb"), "b")
    one = named.join(sets.select(F.col("set_hash").alias("ha"), F.col("shingles").alias("x")), "ha").select("a", "b", "hb", "x")
    two = one.join(sets.select(F.col("set_hash").alias("hb"), F.col("shingles").alias("y")), "hb")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of different components that may reach the threshold, by exact prefix filtering.

    nodes: node, label, n, set_hash. A pair that reaches it shares one of the first n - ceil(percent * n / 100) + 1 shingles of
    either set in one order; in order of rarity those have the shortest postings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for node, label, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node)), pa.array(np.full(len(s), label)), pa.array(np.full(len(s), n)), pa.array(s)], names=["node", "label", "n", "s"])

    own = nodes.join(sets, "set_hash").select("node", "label", "n", "shingles").mapInArrow(run, "node long, label long, n long, s long")
    rare = own.join(own.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "s", "left")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "s"))
    prefix = rare.withColumn("place", place).where(f"place <= n - ceil({percent} * n / 100) + 1 and df is not null").select("node", "label", "n", "s", "place")
    prefix = cut(prefix, "prefixes")
    other = prefix.select(F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), "s", F.col("place").alias("pb"))
    # From the first shared shingle on, what is left of both sets must still reach the overlap that the threshold asks.
    room = f"{100 + percent} * (1 + least(n - place, nb - pb)) >= {percent} * (n + nb)"
    pairs = prefix.join(other, "s").where(f"node < b and label <> lb and 100 * least(n, nb) >= {percent} * greatest(n, nb) and {room}")
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, set_hash, n_shingles, component_id, kept, first_row, one row for each row of docs.

    Texts are linked when the Jaccard similarity of their sets of word shingles is percent / 100 or more, and
    component_id is the smallest doc_id that links reach. kept: doc_id = component_id; first_row marks one row of each
    component, also where doc_ids repeat. A null text counts as empty; texts without words are linked with nothing.
    Texts with fewer words than a shingle are one shingle. Other columns are not read. An empty table gives an empty
    result.
    """
    rows = signatures(docs, words, halves_for(percent / 100), ROWS, id_col, text_col)
    one = F.min(F.struct("row", "n", "first", "second")).alias("one")
    nodes = rows.where("n > 0").groupBy("set_hash").agg(one, F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.select(F.col("one.row").alias("node"), "set_hash", "least_id", "copies", "one.n", "one.first", "one.second"), "nodes")
    held = buckets(nodes.select("node", "first", "second"))
    fetched = cut(nodes.select("node", "set_hash", "n").join(held.select("node").distinct(), "node", "left_semi"), "members")
    sets = full_sets(docs, fetched.select("set_hash"), words, text_col)
    labels = cut(fetched.select("node", F.col("node").alias("label")), "labels")
    for turn in range(STAR_ROUNDS):
        seen = held.join(labels, "node")
        low = F.min(F.struct("label", F.xxhash64("node", F.lit(turn), "bucket"), "node")).alias("low")
        first = seen.groupBy("bucket").agg(low, F.max("label").alias("top")).where("top <> low.label").select("bucket", "low")
        pairs = seen.join(first, "bucket").where("label <> low.label").select(F.col("low.node").alias("a"), F.col("node").alias("b")).distinct()
        labels = merged_labels(labels, cut(verified(pairs, fetched, sets, percent), "links"))
    mixed = held.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    open_nodes = cut(held.join(mixed, "bucket", "left_semi").select("node").distinct().join(labels, "node").join(fetched, "node"), "open")
    if not open_nodes.isEmpty():
        labels = merged_labels(labels, cut(verified(prefix_pairs(open_nodes, sets, percent), fetched, sets, percent), "links"))
    of = cut(nodes.select("node", "set_hash", "least_id", "copies").join(labels, "node", "left").select("set_hash", "least_id", "copies", F.coalesce("label", "node").alias("label")), "set-labels")
    lowest = of.groupBy("label").agg(F.min("least_id").alias("component_id"))
    sets_named = cut(of.join(lowest, "label").select("set_hash", "copies", "label", "component_id"), "named-sets")
    # Texts without words have no label; copies of one set meet its label where they are, if there are many.
    own, none = rows.where("n > 0").select("doc_id", "row", "n", "set_hash"), rows.where("n = 0").select("doc_id", "row", "n", "set_hash")
    named = split_join(own, sets_named, ["set_hash"], "copies", rows.count()).select("doc_id", "row", "set_hash", F.col("n").alias("n_shingles"), "label", "component_id")
    none = none.select("doc_id", "row", "set_hash", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    named = cut(named.unionByName(none), "named")
    one = named.where("label is not null and doc_id <=> component_id").groupBy("label").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("one"))
    return named.join(one, "row", "left").select(
        "doc_id", "row", "set_hash", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"), F.expr("label is null or one is not null").alias("first_row")
    )


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their component, with their own columns, whatever their names.

    Texts without words, null ones among them, all stay but for rows of equal id. Of a component the row with the smallest
    id stays (null ids count only where there is no other); of rows with the same id and set any one. The texts are dealt
    once, by id and set. An empty table gives an empty result.
    """
    names = docs.columns
    at, at_id = fresh(docs, "set", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near_dedup")
        for b in slices(batches):
            key = [xxhash.xxh128_digest(shingles(t, words).tobytes()) for t in text_bytes(b.column(names.index(text_col)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key, pa.binary())], names=[*names, at])

    own = docs.mapInArrow(run, docs.withColumn(at, F.lit(b"")).schema).withColumn(at_id, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    kept = near_duplicates(docs, words, percent, id_col, text_col).where("first_row")
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(at_id), F.col("set_hash").alias(at))
    return own.join(kept, [at_id, at], "left_semi").dropDuplicates([at_id, at]).select(*(F.col(f"`{c}`") for c in names))
