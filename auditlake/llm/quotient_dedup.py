"""Exact duplicates through counting quotient filters.

Each partition puts the fingerprints of its normalised texts into counting quotient filters, one for each range of
fingerprints. A fingerprint's leading bits (quotient) name its home slot; the rest (remainder) is what a slot holds.
Remainders of one quotient form a sorted run, shifted on where slots are taken; a bit for each quotient tells whether it
has a run, a bit for each slot whether a run ends there. A count above one is in a slot of its own after its remainder.
Filters merge without loss, whatever their numbers of slots: read in order they give sorted fingerprints, whose merger
adds the counts; ranges are merged in parallel. Only fingerprints whose merged count is above one route their texts to
the verification, which groups by the whole bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import claim, cut, fresh, slices, split_join, text_bytes

#: Bits of a fingerprint. 2**62 values: as a long it is never negative.
BITS = 62
#: Fingerprints that a range of slots holds on average after the merge.
RANGE_SIZE = 50_000
#: Share of slots that hold a remainder where counts are one.
LOAD = 0.75
#: Bits for each repeated fingerprint in the bitmap that routes texts, and most words of ROUTE_BITS in it: 16 MB. Beyond that
#: more texts are routed than need be, and the result is the same.
BITS_EACH, ROUTE_BITS, MOST_WORDS = 16, 62, 1 << 21
#: Marks a slot that holds a count.
COUNTER = np.uint64(1 << 63)

FILTER_SCHEMA = "range long, quotient_bits int, occupied binary, run_ends binary, slots binary"


def normalise(text: bytes) -> bytes:
    """Each run of ASCII white space becomes one space; nothing else changes."""
    s = b" ".join(text.split())
    if text[:1].isspace():
        s = b" " + s
    if s != b" " and text[-1:].isspace():
        s += b" "
    return s


def fingerprint(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) >> (64 - BITS)


def bitmap(places: np.ndarray, size: int) -> bytes:
    out = np.zeros(size, np.uint8)
    out[places] = 1
    return np.packbits(out).tobytes()


def places_of(bits: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))


def build(values: np.ndarray, counts: np.ndarray, bits: int) -> tuple[int, bytes, bytes, bytes]:
    """A filter of sorted distinct fingerprints of so many bits, with their counts: quotient bits, occupied, run ends, slots."""
    quotient_bits = min(bits, max(1, int(np.ceil(np.log2(max(1, len(values)) / LOAD)))))
    shift = np.uint64(bits - quotient_bits)
    quotient = (values >> shift).astype(np.int64)
    width = 1 + (counts > 1)  # slots of each fingerprint
    at = np.cumsum(width) - width
    held = np.empty(int(width.sum()), np.uint64)
    held[at] = values & ((np.uint64(1) << shift) - np.uint64(1))
    several = np.flatnonzero(counts > 1)
    held[at[several] + 1] = counts[several].astype(np.uint64) | COUNTER
    # Linear probing in order: a slot is the home slot or the one after the last that is taken.
    order = np.arange(len(held))
    place = np.maximum.accumulate(np.repeat(quotient, width) - order) + order
    last = np.flatnonzero(np.r_[quotient[1:] != quotient[:-1], True])
    size = max(1 << quotient_bits, int(place[-1]) + 1)
    slots = np.zeros(size, np.uint64)
    slots[place] = held
    return quotient_bits, bitmap(quotient, 1 << quotient_bits), bitmap(place[at[last] + width[last] - 1], size), slots.tobytes()


def read(quotient_bits: int, occupied: bytes, run_ends: bytes, slots: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    home, end, slots = places_of(occupied), places_of(run_ends), np.frombuffer(slots, np.uint64)
    start = np.maximum(home, np.r_[0, end[:-1] + 1])
    length = end - start + 1
    place = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())
    held, quotient = slots[place], np.repeat(home, length).astype(np.uint64)
    is_counter = held >= COUNTER
    values = (quotient[~is_counter] << np.uint64(bits - quotient_bits)) | held[~is_counter]
    counts = np.ones(len(values), np.int64)
    counts[np.cumsum(~is_counter)[is_counter] - 1] = (held[is_counter] ^ COUNTER).astype(np.int64)
    return values, counts


def merged(remainders: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted fingerprints of several filters with their counts, as one list."""
    keys, at = np.unique(np.concatenate(remainders), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return keys, total


def quotient_filters(fingerprints: DataFrame, range_bits: int) -> DataFrame:
    """The filters of each partition of fingerprints (column fp), one for each range (leading bits), as rows of FILTER_SCHEMA."""
    bits = BITS - range_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            new, n = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.uint64), return_counts=True)
            values, counts = merged([values, new], [counts, n])
        if not len(values):
            return
        own = (values >> np.uint64(bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for a, z in zip(starts, [*starts[1:], len(own)], strict=True):
            row = (int(own[a]), *build(values[a:z] & np.uint64((1 << bits) - 1), counts[a:z], bits))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int32(), *[pa.binary()] * 3), strict=True)], names=["range", "quotient_bits", "occupied", "run_ends", "slots"])

    return fingerprints.select("fp").mapInArrow(run, FILTER_SCHEMA)


def repeated_fingerprints(filters: DataFrame, range_bits: int) -> DataFrame:
    """fp, n: what the merged filters count more than once."""
    bits = BITS - range_bits

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        own = [read(*x, bits) for x in zip(rows["quotient_bits"], rows["occupied"], rows["run_ends"], rows["slots"], strict=True)]
        keys, n = merged([x for x, _ in own], [x for _, x in own])
        keys, n = keys[n > 1], n[n > 1]
        return pd.DataFrame({"fp": ((int(rows["range"].iloc[0]) << bits) | keys).astype(np.int64), "n": n})

    return filters.groupBy("range").applyInPandas(merge, "fp long, n long")


def routed_bits(repeated: DataFrame) -> np.ndarray:
    """A bitmap, sized by their number, that has a bit for each repeated fingerprint, for use before any shuffle of texts."""
    size = min(MOST_WORDS, 1 << max(4, (BITS_EACH * repeated.count() // ROUTE_BITS).bit_length()))
    words = (
        repeated.select(F.expr(f"pmod(fp div {ROUTE_BITS}, {size})").cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(fp % {ROUTE_BITS} as int))").alias("bit"))
        .groupBy("word").agg(F.expr("bit_or(bit)").alias("bits")).collect()
    )
    out = np.zeros(size, np.uint64)
    for w, bits in words:
        out[w] = bits
    return out


def text_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (unique in the table), fp, text_sha256 of each normalised text, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quotient_dedup")
        for b in slices(batches):
            norm = list(map(normalise, text_bytes(b.column(2))))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(map(fingerprint, norm)), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string())], names=["doc_id", "row", "fp", "text_sha256"]
            )

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return cut(own.mapInArrow(run, "doc_id long, row long, fp long, text_sha256 string"), "text-keys")


def routed_texts(docs: DataFrame, bits: np.ndarray, text_col: str = "text") -> DataFrame:
    """fp, norm: the normalised texts whose fingerprint may be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            norm = list(map(normalise, text_bytes(b.column(0))))
            fps = np.fromiter(map(fingerprint, norm), np.uint64, len(norm))
            word, bit = (fps // np.uint64(ROUTE_BITS)) % np.uint64(len(bits)), fps % np.uint64(ROUTE_BITS)
            keep = np.flatnonzero((bits[word] >> bit) & np.uint64(1))
            yield pa.RecordBatch.from_arrays([pa.array(fps[keep].astype(np.int64)), pa.array([norm[i] for i in keep], pa.binary())], names=["fp", "norm"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "fp long, norm binary")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, one row for each row of docs.

    Texts are equal when their normalised bytes are. keep_id is the smallest doc_id of a group of equal texts; of
    repeated rows with that doc_id, exactly one has kept. A null text counts as empty; empty texts are equal to each
    other, not to texts of white space. A null doc_id counts as smaller than any other. Other columns are not read. An
    empty table gives an empty result.
    """
    keys = text_keys(docs, id_col, text_col)
    total = keys.count()
    range_bits = max(1, (total // RANGE_SIZE).bit_length())
    repeated = cut(repeated_fingerprints(quotient_filters(keys, range_bits), range_bits), "repeated")
    # Equal texts meet here as bytes; copies in one task are counted before the shuffle.
    same = (
        routed_texts(docs, routed_bits(repeated), text_col).groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("texts"))
        .where("texts > 1").select("fp", F.sha2("norm", 256).alias("text_sha256"), "texts")
    )
    first = F.min(F.struct("doc_id", "row"))
    groups = keys.groupBy("fp", "text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = cut(groups.join(same, ["fp", "text_sha256"]).where("size = texts").select("fp", "text_sha256", "first", "size"), "groups")
    return split_join(keys, groups, ["fp", "text_sha256"], "size", total).select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, with their own columns, whatever their names: one for each different text.

    Of repeated rows with the same id and text any one stays. Of null and empty texts, which are equal, the one with the
    smallest id stays, a null id before all. The texts are dealt once, by id and hash. An empty table gives an empty result.
    """
    names = docs.columns
    at, at_id = fresh(docs, "sha", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sha = [hashlib.sha256(normalise(t)).hexdigest() for t in text_bytes(b.column(names.index(text_col)))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sha, pa.string())], names=[*names, at])

    schema = docs.withColumn(at, F.lit("")).schema
    own = docs.mapInArrow(run, schema).withColumn(at_id, F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    found = exact_duplicates(docs, id_col, text_col).where("kept")
    found = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias(at_id), F.col("text_sha256").alias(at))
    return own.join(found, [at_id, at], "left_semi").dropDuplicates([at_id, at]).select(*(F.col(f"`{c}`") for c in names))
