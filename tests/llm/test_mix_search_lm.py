import math
import zlib
from collections import Counter

import numpy as np
import pytest

from auditlake.llm.entropy_mix import diffuse, mix, mixed_documents, solve_dual, source_targets, with_rates
from auditlake.llm import maxent_lm
from auditlake.llm.maxent_lm import Head, features, histories, lists_for, log_scores, rows_for, score_texts, tokens, train
from auditlake.llm.topk import Best, candidates, tile, top_k, usable_vectors


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        # Weights 3, 1, 2, 3 of 465: 155, 51.67, 103.33, 155, of which the last is above 20; 445 by 3, 1, 2 is above 200 for a.
        ({"a": 100, "b": 100, "c": 100, None: 10}, {"a": 200.0, "b": 245 / 3, "c": 490 / 3, None: 20.0}),
        # 3 to 1 of 300: 225 is above 200, and b takes the rest.
        ({"a": 100, "b": 100}, {"a": 200.0, "b": 100.0}),
        ({"b": 10, "a": 1000}, {"a": 1495.0, "b": 20.0}), ({"x": 40}, {"x": 60.0}), ({"a": 0}, {"a": 0.0}), ({}, {}),
        # Weights 3, 1, 2, 3, 1 of 450: the two of weight 3 are full at 120, the others share 210 by 1, 2, 1.
        ({"Z": 60, "a": 60, "\u00e9": 60, "\U0001f600": 60, None: 60}, {"Z": 120.0, "a": 52.5, "\u00e9": 105.0, "\U0001f600": 120.0, None: 52.5}),
    ],
)
def test_targets_written_by_hand(spark, sizes, want):
    sources = spark.createDataFrame([("" if s is None else f"={s}", n) for s, n in sizes.items()], "key string, source_size long")
    got = {r.key[1:] if r.key else None: r.target for r in with_rates(source_targets(sources)).collect()}
    assert got == pytest.approx(want)


def test_rates_are_the_tilt_that_meets_the_targets(spark):
    rows = [("=a", 100, 150.0), ("=b", 100, 1e-6), ("=c", 7, 14.0), ("=d", 0, 0.0), ("=e", 10**12, 3.0)]
    got = {r.key: r.rate for r in with_rates(spark.createDataFrame(rows, "key string, source_size long, target double")).collect()}
    assert got == pytest.approx({"=a": 1.5, "=b": 1e-8, "=c": 2.0, "=d": 1.0, "=e": 3e-12}, rel=1e-3)


def test_diffusion_keeps_what_small_documents_can_make_good():
    import pandas as pd

    cells = lambda sizes, target: pd.DataFrame({"key": "x", "size": list(sizes), "n": list(sizes.values()), "rate": target / sum(k * n for k, n in sizes.items()), "source_size": 0, "target": target})
    for sizes, target in (({1000: 1, 10: 20, 1: 9}, 1700.0), ({1000: 1, 10: 20, 1: 9}, 900.0), ({50: 3, 7: 4, 3: 5}, 250.0), ({9: 10}, 121.0)):
        got = diffuse(cells(sizes, target))
        taken = int((got["size"] * got["copies"]).sum())
        assert all(0 <= c <= 2 * n for c, n in zip(got["copies"], got["n"], strict=True))
        # No choice of copies comes nearer than this.
        sums = {0}
        for k, n in sizes.items():
            sums = {s + k * m for s in sums for m in range(2 * n + 1)}
        assert abs(taken - target) <= max(min(abs(x - target) for x in sums), min(sizes)), (sizes, target, taken)


def test_mix_meets_its_targets(docs, rows):
    got = mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, *_ in rows)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        n = sum(r.size for r in own)
        assert all(r.source_size == n and r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
        sums = 1  # bit x: some choice of copies takes x words
        for r in own:
            sums |= sums << r.size | sums << 2 * r.size
        best = min((abs(x - own[0].target) for x in range(2 * n + 1) if sums >> x & 1), default=0)
        assert abs(sum(r.taken for r in own) - own[0].target) <= best + min((r.size for r in own if r.size), default=0)
    assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got) + 200
    whole = mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in got)


@pytest.mark.parametrize("part_rows", [500_000, 3])
def test_the_mix_does_not_depend_on_partitions(spark, docs, monkeypatch, part_rows):
    from auditlake.llm import entropy_mix

    monkeypatch.setattr(entropy_mix, "PART_ROWS", part_rows)
    got = [sorted(map(repr, mix(docs.repartition(n)).collect())) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_targets_and_sources_against_sql(spark):
    import os

    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    # Sizes and targets by plain SQL: the level at which weight * level, at most twice the size, adds up to one and a half times all.
    sql = f"""WITH RECURSIVE d AS (SELECT doc_id, source, len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']) AS size FROM '{folder}/documents.parquet'),
      s AS (SELECT source, sum(size) AS n, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM d GROUP BY source),
      walk AS (SELECT 0 AS turn, CAST(0 AS DOUBLE) AS level UNION ALL
        SELECT turn + 1, (SELECT (1.5 * sum(n) - coalesce(sum(2 * n) FILTER (WHERE w * level > 2 * n), 0)) / sum(w) FILTER (WHERE NOT w * level > 2 * n) FROM s) FROM walk WHERE turn < 30)
      SELECT d.doc_id, d.size, s.n AS source_size, least(w * (SELECT max(level) FROM walk), 2 * n) AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"""
    want = {i: (size, n, t) for i, size, n, t in duckdb.connect().execute(sql).fetchall()}
    got = mix(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert {r.doc_id: (r.size, r.source_size) for r in got} == {i: x[:2] for i, x in want.items()}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.doc_id][2])
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.01 * r.target for r in got)


def test_clashing_names_in_the_mix(spark):
    names = ["hash", "id", "key", "nth", "copies", "copy", "size", "part", "Hash_"]
    df = spark.createDataFrame([(i, "a b c", "s", *(["x"] * len(names))) for i in range(9)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixed_documents(df)
    assert got.columns == df.columns and {tuple(r)[3:] for r in got.collect()} == {("x",) * len(names)}


def test_dual_meets_two_margins(spark):
    cells = [("a", "x", 100.0), ("a", "y", 300.0), ("b", "x", 200.0), ("b", "y", 50.0)]
    goals = {("s", "a"): 500.0, ("s", "b"): 200.0, ("l", "x"): 350.0, ("l", "y"): 350.0}
    lam = solve_dual(spark.createDataFrame(cells, "s string, l string, size double"), ["s", "l"], goals)
    rate = {(s, x): min(2.0, math.exp(lam["s", s] + lam["l", x])) for s, x, _ in cells}
    for (m, v), goal in goals.items():
        assert abs(sum(n * rate[s, x] for s, x, n in cells if v in (s, x)) - goal) < 1e-4 * goal, m


def test_mix_of_nothing(no_docs):
    assert mix(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_top_k_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(r.normal(size=6), 2)], 0) for i in range(300)]
    rows += [(300, None, 0), (301, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (303, [float("inf")] * 6, 0), (304, [], 0), (305, rows[0][1], 0), (306, rows[0][1], 0), (None, [1.0] * 6, 0), (7, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(4)
    got = sorted(tuple(x) for x in top_k(df.where("vec_id % 50 = 0"), df, block_rows=37, query_rows=4).collect())
    own = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in own if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], v, strict=True)), i) for i, v in own.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_tiles_are_exact_beyond_doubles():
    q = np.array([[2.0**40, 1.0]])
    v = np.array([[2.0**20, 1.0], [2.0**20, 2.0]])
    assert tile((np.array([9]), q), (np.array([1, 2]), v), 5)[2].tolist() == [2**60 + 2, 2**60 + 1]


@pytest.mark.parametrize("parts", [1, 5])
def test_rows_that_share_an_id_are_all_candidates(spark, parts):
    rows = [(0, [1.0]), (0, [-1.0]), (0, [1.0]), (1, [2.0]), (1, [5.0]), (1, [5.0]), (2, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
    got = Counter(tuple(r) for r in top_k(df.where("vec_id = 0"), df, k=2, scale=1, block_rows=2).collect())
    assert got == Counter([(0, 1, 1, 5), (0, 2, 2, 3), (0, 1, 1, -2), (0, 2, 2, -3)])


def test_search_broadcasts_neither_side(spark):
    r = np.random.default_rng(3)
    v = np.round(r.normal(size=(2000, 8)), 2)
    v[500:900] = v[500]  # copies: ties to the smaller id
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>").repartition(3)
    found = top_k(df.where("vec_id % 50 = 0"), df, block_rows=64)
    # Queries dealt to every block of vectors used to be broadcast: many times the queries, in the driver's memory.
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    x = np.floor(256 * v).astype(np.int64)
    want = [(q, k + 1, i, int(s)) for q in range(0, 2000, 50) for k, (s, i) in enumerate([(s, i) for s, i in sorted(zip((x @ x[q]).tolist(), range(2000), strict=True), key=lambda t: (-t[0], t[1])) if i != q][:5])]
    assert sorted(tuple(t) for t in found.collect()) == want


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_copies_that_no_list_can_hold_are_no_candidates(spark, kind):
    rows = [(i, [0 if i % 2 else 1, 3]) for i in range(100)] + [(4, [1, 3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>").selectExpr("vec_id", f"cast(embedding as array<{kind}>) embedding").repartition(5)
    assert sorted(r["vec_id"] for r in candidates(usable_vectors(df), 5).collect()) == list(range(12))
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in top_k(df.where("vec_id in (4, 51)"), df, k=5).collect()}
    assert got == {(4, i + 1): x for i, x in enumerate([0, 2, 6, 8, 10])} | {(51, i + 1): i for i in range(5)}


@pytest.mark.parametrize("high, odd", [(3, 0), (1000, 0), (1 << 20, 0), (3, 1 << 40), (1 << 20, 1 << 30)])
def test_best_rows_by_blocks(high, odd):
    r = np.random.default_rng(high)
    q, v = (r.integers(-high, high + 1, (n, 4)).astype(np.float64) for n in (700, 2100))
    if odd:
        q[5], v[17], v[1500] = odd, odd + 1, -odd
    qi, vi = np.arange(700) * 3, r.permutation(2100)
    vi[100] = vi[200]  # two rows share an id
    best = Best(qi, q, 5)
    for at in np.array_split(np.arange(2100), [3, 9, 1300]):
        at = at[np.argsort(vi[at], kind="stable")]
        best.add(vi[at], v[at])
    rows = [[int(x) for x in row] for row in v]
    for i in [*range(0, 700, 35), 5]:
        own = [int(x) for x in q[i]]
        want = sorted((-sum(a * b for a, b in zip(own, row, strict=True)), j) for row, j in zip(rows, vi.tolist(), strict=True) if j != qi[i])[:5]
        most = (1 << 63) - 1
        assert [(max(-most, min(most, -s)), j) for s, j in want] == list(zip(best.scores[i].tolist(), best.vecs[i].tolist(), strict=True)), i


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in top_k(df.where("vec_id = 0"), df).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(df.where("false"), df.where("false")).count() == 0


def test_language_model_base_and_gain(spark, docs, rows):
    got = score_texts(docs, head_words=25)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens((t or "").encode()))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in rows:
        own = tokens((t or "").encode())
        want[(i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own), 6))] += 1
    found = got.collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_model_learns_an_order(spark):
    text = "one two three four five six seven eight " * 20
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    held = [r for r in score_texts(docs).collect() if r.held_out]
    assert held and all(r.score > r.base_score * 0.7 for r in held)


def test_features_start_anew_with_each_text():
    hashes = histories(np.array([4, 5, 6, 4, 5, 9]), np.array([0, 3, 5]))
    assert (hashes[:, 0] == hashes[:, 3]).all() and (hashes[:, 1] == hashes[:, 4]).all() and (hashes[:, 5] == hashes[:, 0]).all()
    rows, more = features(hashes, 64), features(hashes, 64, np.zeros(6, np.int64))
    assert rows.min() >= 0 and rows.max() < 3 * 64 <= more.min() and more.max() < 6 * 64


def small_model():
    r = np.random.default_rng(3)
    counts = np.array([50, 40, 40, 30, 9, 5, 2, 2])
    words = [f"w{i}".encode() for i in range(8)]
    rest = np.array([[3, 2], [4, 1], [0, 0], [1, 1]])
    head = Head(words, counts, int(counts.sum() + rest[:, 0].sum()), 8 + int(rest[:, 1].sum()), rest, classes=3, subclasses=4)
    return head, r.normal(size=(6 * 32, 4)).astype(np.float32)


def test_probabilities_add_up_to_one():
    """Over all words of the head, all others and one unseen place in each subclass, after any history."""
    head, weights = small_model()
    for history in ([], [3], [3, 1], [70, 9], [2, 2, 2]):
        total = 0.0
        for code in range(8 + 4):
            codes = np.array([*history, code])
            p = 10 ** log_scores(head, weights, codes, np.array([0]))[-1]
            # A code behind the head stands for its subclass, whose words weigh their counts plus one, with one unseen.
            rest = [[3, 2], [4, 1], [0, 0], [1, 1]][code - 8] if code >= 8 else None
            total += p if rest is None else p * (sum(rest) + 1)
        assert total == pytest.approx(1.0, rel=1e-5), history


def test_scores_against_a_plain_softmax():
    head, weights = small_model()
    codes, starts = np.array([0, 5, 3, 100, 2, 7, 7]), np.array([0, 4])
    got, buckets = log_scores(head, weights, codes, starts), 32
    for i, code in enumerate(codes.tolist()):
        hashes = histories(codes, starts)[:, i : i + 1]
        cell = int(head.cells(codes)[i])
        c, sub = divmod(cell, 4)
        # The matrix is as wide as the larger softmax; classes beyond the last have no tokens and no part in it.
        one = weights[features(hashes, buckets)[:, 0]].astype(float).sum(axis=0)[: head.classes] + head.bias
        two = weights[features(hashes, buckets, np.array([c]))[:, 0]].astype(float).sum(axis=0) + head.sub_bias[c]
        count = head.counts[code] if code < 8 else 0
        want = math.log10(math.exp(one[c]) / sum(map(math.exp, one))) + math.log10(math.exp(two[sub]) / sum(map(math.exp, two))) + math.log10(count + 1) - head.log_mass[cell]
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_rows_grow_with_the_words():
    assert rows_for(0) == rows_for(1000) == 1 << 12 and rows_for(1 << 20) == 1 << 14 and rows_for(1 << 22) == 1 << 16 and rows_for(1 << 40) == 1 << 18


def test_language_model_of_nothing(no_docs):
    assert score_texts(no_docs).count() == 0


@pytest.mark.parametrize("name", ["pipeline"])
def test_pipeline_stages(spark, docs, rows, tmp_path, name):
    import corpus_pipeline

    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(*keep).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    own = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for stage, f in corpus_pipeline.STAGES[:-1]:
        new = f(spark, own, str(tmp_path))
        assert new.columns == keep, stage
        new.write.parquet(str(tmp_path / stage))
        own = spark.read.parquet(str(tmp_path / stage))
    packed = corpus_pipeline.STAGES[-1][1](spark, own, str(tmp_path))
    assert packed.where("piece = 0").count() == own.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_lists_follow_cores_and_tokens():
    assert lists_for(0, 10, 8) == 8 and lists_for(100_000_000, 10, 8) == 25 and lists_for(10**12, 1 << 24, 4000) == 10**12 >> 24


def test_any_number_of_lists_merges_to_their_average(spark, monkeypatch):
    """More lists than two merges take: what comes out is the average by tokens of what each part makes alone."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(maxent_lm, "FAN_IN", 3)
    head, weights = small_model()
    r = np.random.default_rng(3)
    parts = [r.integers(0, 8, r.integers(5, 40)).astype(np.int32) for _ in range(31)]
    sent = spark.sparkContext.broadcast(head)
    rows = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(parts)], "i int, codes binary")
    one = [train(rows.where(F.col("i") == i).coalesce(1), sent, weights, 0).astype(np.float64) for i in (0, 7)]
    two = train(rows.where("i IN (0, 7)").repartitionByRange(2, "i"), sent, weights, 0)
    n = [len(parts[i]) for i in (0, 7)]
    assert np.allclose(two, (one[0] * n[0] + one[1] * n[1]) / sum(n), atol=4e-3)
    monkeypatch.setattr(maxent_lm, "lists_for", lambda *a: 31)
    many = train(rows.repartitionByRange(31, "i"), sent, weights, 0)
    alone = [train(rows.where(F.col("i") == i).coalesce(1), sent, weights, 0).astype(np.float64) for i in (0, 30)]
    assert many.shape == weights.shape and np.isfinite(many).all() and not np.allclose(many, weights) and np.abs(many - weights).max() <= max(np.abs(a - weights).max() for a in alone) + 1


def test_words_of_many_texts_at_once():
    """As the tokens of each text, whatever white space there is; each different word is looked up once."""
    import pyarrow as pa

    texts = ["", " ", "\n\t", " A b ", "b  B\u00c9 \u00c9\x0b", "x\x1cy\x85z\u00a0\u3000w", "a\x0cb\r\n", "\u0130I"] * 3
    words, offsets = maxent_lm.words_of(pa.array(["skipped", *texts]).slice(1))
    flat = [w.encode() for w in words.to_pylist()]
    assert [[*flat[i:j], b"\n"] for i, j in zip(offsets, offsets[1:], strict=False)] == [tokens(t.encode()) for t in texts]


def test_codes_count_and_look_up_each_different_word_once(spark, monkeypatch):
    texts = ["", None, " ", "a b a", "zz a\tZZ qq", "b " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    counts = {r["word"]: r["c"] for r in maxent_lm.word_counts(docs.select("text")).collect()}
    assert counts == Counter(w.decode() for t in texts for w in tokens((t or "").encode()))
    head, asked = Head([b"a", b"\n"], np.array([3, 6]), 64, 5, np.ones((16, 2), np.int64)), spark.sparkContext.accumulator(0)
    codes = maxent_lm.Codes(head)

    class Asked(maxent_lm.Codes):
        def __getitem__(self, word):
            asked.add(1)
            return super().__getitem__(word)

    monkeypatch.setattr(maxent_lm, "opened", lambda sent: (head, Asked(head)))
    got = {r["doc_id"]: r for r in maxent_lm.encode(docs, None, "doc_id", "text").collect()}
    assert asked.value == 5
    for i, t in enumerate(texts):
        own = tokens((t or "").encode())
        assert np.frombuffer(got[i]["codes"], np.int32).tolist() == [codes[w] for w in own]
        assert Counter(got[i]["tail"]) == Counter(w.decode() for w in own if w not in (b"a", b"\n"))
        assert (got[i]["n_tokens"], got[i]["known"]) == (len(own), sum(w in (b"a", b"\n") for w in own))
        assert np.isclose(got[i]["logs"], sum({b"a": np.log10(4), b"\n": np.log10(7)}.get(w, 0) for w in own))


@pytest.mark.parametrize("large", [0.0, 300.0])
def test_a_step_takes_the_gradient_of_the_softmax(large):
    """Against rows one by one, also where logits are beyond what single precision's exponentials hold."""
    r = np.random.default_rng(6)
    weights, squares = r.normal(0, 1, (12, 5)), r.uniform(1, 2, (12, 5))
    weights[3] += [large, 0, -large, 0, large / 2]
    bias, rows, goal = r.normal(0, 1, (40, 5)), r.integers(0, 4, (3, 40)) + np.array([[0], [4], [8]]), r.integers(0, 5, 40)
    rows[0, 0], goal[0] = 3, 1
    z = weights[rows].sum(axis=0) + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(40), goal] -= 1
    want, seen = weights.copy(), squares.copy()
    for k in range(12):
        at = (rows[k // 4] == k).nonzero()[0]
        if len(at):
            g = p[at].sum(axis=0) / np.sqrt(len(at))
            seen[k] += g * g
            want[k] -= 0.4 * g / np.sqrt(seen[k])
    w, s = weights.astype(np.float32), squares.astype(np.float32)
    maxent_lm.step(w, s, bias.astype(np.float32), rows, goal, 0.4)
    assert np.allclose(w, want, atol=2e-4) and np.allclose(s, seen, atol=2e-4)


def test_search_holds_what_no_long_holds(spark):
    from auditlake.llm.topk import top_k

    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e16, 0.0]), (2, [-1e300, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df.where("vec_id = 0"), df, k=5, scale=256).collect()}
    most = (1 << 63) - 1
    # 128 * 2**62 is beyond a long as well: the exact products still rank before they are held.
    assert got == {(0, 1): (1, most), (0, 2): (3, most), (0, 3): (2, -most)}
