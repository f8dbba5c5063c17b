import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm.components import connected_components, merged_labels
from auditlake.llm.near_dedup import MISS, ROWS, halves_for, near_duplicates, prefix_pairs, shingles, without_near_duplicates
from auditlake.llm.quotient_dedup import build, exact_duplicates, merged, normalise, read, quotient_filters, repeated_fingerprints, without_duplicates


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "", flags=re.A)


@pytest.mark.parametrize("text", ["", " ", "a", " a\t\nb ", "\x0b\x0c", "a\x00 b", "é ü  x"])
def test_normalise(text):
    assert normalise(text.encode()) == plain(text).encode()


def test_exact_duplicates_against_brute_force(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[plain(t)].append(i)
    least = lambda ids: min(ids, key=lambda x: (x is not None, x))
    want = sorted(repr((i, least(groups[plain(t)]), len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest())) for i, t, *_ in rows)
    got = exact_duplicates(docs).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = without_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(plain(r.text) for r in kept.collect()) == sorted(groups)


def test_filters_merge_without_loss(spark):
    r = random.Random(1)
    values = [r.randrange(1 << 62) for _ in range(300)] + [7] * 40 + [1 << 61] * 3
    found = repeated_fingerprints(quotient_filters(spark.createDataFrame([(v,) for v in values], "fp long").repartition(4), 5), 5).collect()
    assert {(x.fp, x.n) for x in found} == {(7, 40), (1 << 61, 3)}
    keys, n = merged([np.array([1, 3], np.uint64), np.array([3, 5], np.uint64)], [np.array([1, 2]), np.array([4, 1])])
    assert keys.tolist() == [1, 3, 5] and n.tolist() == [1, 6, 1]


def test_filters_give_back_what_was_put_in():
    r = random.Random(7)
    for bits in (4, 20, 62):
        for n in (1, 2, 13, 400):
            values = sorted({r.randrange(1 << bits) if r.random() < 0.6 else r.randrange(1 << bits) % 7 for _ in range(n)})
            counts = [r.choice([1, 1, 1, 2, 3, 10**12]) for _ in values]
            quotient_bits, occupied, run_ends, slots = build(np.array(values, np.uint64), np.array(counts), bits)
            got = read(quotient_bits, occupied, run_ends, slots, bits)
            assert got[0].tolist() == values and got[1].tolist() == counts
            # Slots: one for each fingerprint and one for each count above one; run ends: one for each quotient.
            quotients = {v >> bits - quotient_bits for v in values}
            assert sum(map(int.bit_count, occupied)) == len(quotients) == sum(map(int.bit_count, run_ends))
            assert len(slots) // 8 >= len(values) + sum(c > 1 for c in counts)


def test_groups_that_hold_many_rows_meet_them_where_they_are(spark, docs, monkeypatch):
    from auditlake.llm import common

    want = sorted(map(repr, exact_duplicates(docs).drop("kept").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert sorted(map(repr, exact_duplicates(docs).drop("kept").collect())) == want
    near = sorted(map(repr, near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100_000)
    assert sorted(map(repr, near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect())) == near


@pytest.mark.parametrize("keep", [without_duplicates, without_near_duplicates])
def test_clashing_names(spark, keep):
    names = ["sha", "id", "set", "row", "n", "Sha_", "node", "key"]
    df = spark.createDataFrame([(i, "a b c d e f", *(["x"] * len(names))) for i in range(9)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = keep(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(0, "a b c d e f", *(["x"] * len(names)))]


def linked(rows, words, percent):
    sets = [set(shingles((t or "").encode(), words).tolist()) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[root(a)] = root(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = []
    for own in groups.values():
        least = min((rows[i][0] for i in own if rows[i][0] is not None), default=None)
        out += [repr((rows[i][0], len(sets[i]), least)) for i in own]
    return sorted(out), len(groups)


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(docs, rows, words, percent):
    want, n = linked(rows, words, percent)
    got = near_duplicates(docs, words, percent).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == want
    assert sum(r.first_row for r in got) == n
    assert without_near_duplicates(docs, words, percent).count() == n


def test_prefix_join_loses_no_link(spark):
    r = random.Random(4)
    sets = []
    for _ in range(12):
        base = [r.randrange(1 << 60) for _ in range(40)]
        for _ in range(5):
            sets.append(sorted({*base[r.randrange(6) :], *(r.randrange(1 << 60) for _ in range(r.randrange(4)))}))
    nodes = spark.createDataFrame([(i, i, len(s), bytearray([i])) for i, s in enumerate(sets)], "node long, label long, n long, set_hash binary")
    full = spark.createDataFrame([(bytearray([i]), bytearray(np.array(s, np.int64).tobytes())) for i, s in enumerate(sets)], "set_hash binary, shingles binary")
    found = {(x.a, x.b) for x in prefix_pairs(nodes, full, 85).collect()}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(set(sets[a]) & set(sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                assert (a, b) in found


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 499)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(21)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[500] == 499


def test_labels_merge_by_contraction(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (5, 5), (6, 5), (9, 9), (12, 12)], "node long, label long")
    links = spark.createDataFrame([(1, 6), (0, 1), (9, 12)], "a long, b long")
    assert {r.node: r.label for r in merged_labels(labels, links).collect()} == {0: 0, 1: 0, 5: 0, 6: 0, 9: 9, 12: 9}


def test_tables_for_the_miss_rate():
    for s in (0.8, 0.85):
        n = halves_for(s)
        assert 2 * (1 - s**ROWS) ** n <= MISS < 2 * (1 - s**ROWS) ** (n - 1)


def test_empty_tables(no_docs):
    assert exact_duplicates(no_docs).count() == 0
    assert near_duplicates(no_docs).count() == 0
    assert without_duplicates(no_docs).count() == 0


def test_routing_hash_is_sparks(spark):
    import xxhash

    row = spark.createDataFrame([(bytearray(b"abcdefgh12345678"),)], "b binary").select(F.xxhash64("b").alias("h")).first()
    assert row.h & ((1 << 62) - 1) == xxhash.xxh64_intdigest(b"abcdefgh12345678", 42) & ((1 << 62) - 1)
