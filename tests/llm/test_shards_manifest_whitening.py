"""Shards, manifest proofs and whitening against plain versions."""

import bisect
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.llm import merkle, sharding, whitening
from tests.llm.conftest import SCHEMA

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# Shards


def shards_by_hand(groups, shards, large):
    """Smallest capacity and shard of each key, by trying cuts on the whole line."""
    total, own = sum(s for _, s in groups), []
    rest, known = total, sorted((g for g in groups if g[1] * large > total), key=lambda g: (-g[1], g[0]))
    while known and len(own) < shards - 1 and known[0][1] * (shards - len(own)) >= rest:
        own.append(known.pop(0))
        rest -= own[-1][1]
    line, k = sorted(known) + sorted(g for g in groups if g[1] * large <= total), shards - len(own)
    ends = [0]
    for _, s in line:
        ends.append(ends[-1] + s)
    whole = ends[-1]

    def fits(c):
        at = 0
        for _ in range(k):
            at = max(e for e in ends if e <= at + c)
        return at == whole

    low, high = max([-(-whole // k), *(s for _, s in line)]), whole
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    least = [0] * k + [whole]
    for j in range(k - 1, 0, -1):
        least[j] = min(e for e in ends if e >= least[j + 1] - low)
    cuts = [0]
    for j in range(1, k):
        aim = j * whole // k
        before, after = max(e for e in ends if e <= aim), min(e for e in ends if e >= aim)
        near = before if aim - before <= after - aim else after
        cuts.append(min(max(near, least[j], cuts[-1]), max(e for e in ends if e <= cuts[-1] + low)))
    out = {key: i for i, (key, _) in enumerate(own)}
    return low, out | {key: len(own) + bisect.bisect_right(cuts[1:], ends[i]) for i, (key, _) in enumerate(line)}


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_the_smallest_capacity(spark, seed):
    r = random.Random(seed)
    groups = [(k, r.choice([8, 9, r.randint(8, 60), r.randint(8, 900)])) for k in r.sample(range(1 << 60), 150)]
    if seed == 1:
        groups[0] = (groups[0][0], 200_000)
    table = spark.createDataFrame(groups, "key long, size long").repartition(3)
    # Few cells: the cuts are found only after several rounds of finer ranges.
    made = sharding.plan(table, 24 if seed != 2 else 5, large=64, cells=8)
    capacity, want = shards_by_hand(groups, made.shards, 64)
    got = {x["key"]: x["shard"] for x in sharding.with_shard(table, made, "key", "shard").collect()}
    assert (made.capacity, got) == (capacity, want)


def test_shards_keep_groups_and_number_slots(docs, rows):
    got = sharding.shard_rows(docs, 6).collect()
    assert len(got) == len(rows)
    text_of, by_shard = {}, {}
    for i, t in ((r[0], r[1]) for r in rows):
        text_of.setdefault(i, set()).add((t or "").encode())
    for g in got:
        assert (g["size"], g["text_crc32"]) in {(len(t) + 8, zlib.crc32(t)) for t in text_of[g["doc_id"]]}
        assert g["law"] == "bytes" and g["grown_shard"] is None and 0 <= g["shard"] < 6
        by_shard.setdefault(g["shard"], []).append(g)
    shard_of = {}
    for g in got:  # sizes and checksums tell the texts of the fixture apart
        assert shard_of.setdefault((g["size"], g["text_crc32"]), g["shard"]) == g["shard"]
    for own in by_shard.values():
        assert sorted(g["slot"] for g in own) == list(range(len(own)))
    groups = {}
    for i, t in ((r[0], (r[1] or "").encode()) for r in rows):
        key = int(hashlib.sha256(t).hexdigest()[:15], 16)
        groups[key] = groups.get(key, 0) + len(t) + 8
    sums = {s: sum(g["size"] for g in own) for s, own in by_shard.items()}
    capacity, want = shards_by_hand(sorted(groups.items()), 6, sharding.LARGE)
    assert max(sums.values()) <= max(capacity, max(groups.values()))
    assert sums == {s: sum(v for k, v in groups.items() if want[k] == s) for s in set(want.values())}


def test_own_columns_and_files(docs, no_docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard"}
    assert {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert sharding.shard_rows(no_docs).count() == 0


def test_one_text_and_more_shards_than_texts(spark):
    df = spark.createDataFrame([(i, "same", "en", "s", 1) for i in range(50)], SCHEMA)
    got = sharding.shard_rows(df).collect()
    assert len({g["shard"] for g in got}) == 1 and sorted(g["slot"] for g in got) == list(range(50))


# Manifest


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, g):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + g])) for i in range(0, len(out[-1]), g)])
    return out


def steps(made, i, g):
    out = []
    for level in made[:-1]:
        run = i // g * g
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + g])))
        i //= g
    return out


def by_hand(rows, g=2):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    values = lambda r, more=0: [r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]]
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(values(r))))
    trees = {x: levels([leaf(values(r)) for r in langs[x]], g) for x in order}
    top = levels([trees[x][-1][0] for x in order], g)
    out = []
    for place, x in enumerate(order):
        for i, r in enumerate(langs[x]):
            path = steps(trees[x], i, g) + steps(top, place, g)
            own = leaf(values(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)))
            for before, after in path:
                own = h(before + own + after)
            out.append((r[0], leaf(values(r)), trees[x][-1][0], top[-1][0], h("".join(b + a for b, a in path)), own, own == top[-1][0]))
    return sorted(out, key=repr)


def verified(df, fan_out=2):
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    got = merkle.verified_rows(df, {"n_chars": F.col("n_chars") + 1}, altered, FIELDS, fan_out=fan_out)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=repr)


@pytest.mark.parametrize("fan_out", [2, 3])
def test_proofs_by_hand(docs, rows, fan_out):
    want = by_hand(rows, fan_out)
    assert verified(docs, fan_out) == want
    assert {w[-1] for w in want} == {True, False}


def test_levels_above_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    monkeypatch.setattr(merkle, "SHARED", 2)
    rows = [(i, f"t{i % 7}", ("en", "de", None)[min(2, i // 60)], "s", i) for i in range(90)] + [(5, "t5", "fr", "s", 5)] * 3 + [(500, None, "es", None, None)]
    assert verified(spark.createDataFrame(rows, SCHEMA).repartition(6)) == by_hand(rows)


def test_one_row_and_none(spark, no_docs):
    one = [(7, "x", "en", "s", 1)]
    assert verified(spark.createDataFrame(one, SCHEMA)) == by_hand(one)
    assert verified(no_docs) == []
    assert merkle.manifest(no_docs).root is None


# Whitening


def vectors(seed=1, n=300, d=40):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3 + r.normal(size=d)).astype(np.float32)


def test_jacobi_keeps_small_eigenvalues():
    scale = np.diag(10.0 ** -np.arange(0, 16, 2))
    near = scale @ (np.eye(8) + 0.1 * np.ones((8, 8))) @ scale
    values, found = whitening.jacobi(near)
    assert np.allclose(found @ found.T, np.eye(8), atol=1e-14)
    # Products of leading minors by whole-number arithmetic: the determinant is known.
    assert np.prod(values / np.diag(scale) ** 2) == pytest.approx(1.8, rel=1e-12)
    values, found = whitening.jacobi(np.zeros((3, 3)))
    assert values.tolist() == [0, 0, 0] and np.allclose(found, np.eye(3))


def test_whitening_by_numpy(spark):
    x = vectors()
    bad = [(1000, None), (1001, [None] + [0.0] * 39), (1002, [float("nan")] + [0.0] * 39), (1003, [float("inf")] * 40), (1004, [])]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad + [(0, x[0].tolist()), (None, x[1].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n", F.lit(1)).withColumn("dim", F.lit("x")).repartition(4)
    got = whitening.whiten(df).toPandas()
    fitted = np.concatenate([x, x[:2]])
    whole = np.floor(64 * fitted.astype(float)) + 1_000_000
    n, own = len(whole), whole - whole.mean(axis=0)
    values, found = np.linalg.eigh(own.T @ own / n)
    want = (own @ found[:, ::-1][:, :32]) / np.sqrt(values[::-1][:32])
    assert len(got) == n * 32 and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    plain = got[got["vec_id"].between(2, 299)].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((plain * want[2:300]).sum(axis=0))
    assert np.abs(plain * sign - want[2:300]).max() < 1e-8
    assert np.allclose(got.groupby("component")["explained"].first(), values[::-1][:32] / values.sum(), rtol=1e-10)
    sums = [int(s) for s in whole.sum(axis=0)]
    for i in (2, 77, 299):
        assert set(got[got["vec_id"] == i]["deviation"]) == {sum((n * int(a) - s) ** 2 for a, s in zip(whole[i], sums, strict=True))}
    assert (got["vec_id"] == 0).sum() == 64 and got["vec_id"].isna().sum() == 32


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    # One vector has no variance; a component without variance is 0; lengths are fitted apart.
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 5.0, 5.0])], schema)).toPandas()
    assert got[got["vec_id"] == 3]["whitened"].tolist() == [0, 0, 0]
    assert sorted(got[got["component"] == 1]["whitened"].abs()) == [0, 1, 1] and got[(got["vec_id"] == 1) & (got["component"] == 2)]["whitened"].tolist() == [0]
    assert set(got["identity_error"]) == {0.0}
    # Finite components of any size don't stop the job; a deviation that no long holds is null.
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 0.5])], schema)).toPandas()
    assert len(huge) == 6 and huge[huge["vec_id"] == 1]["deviation"].isna().all()
