"""The pipeline's stages, each against a brute-force version of itself on what its predecessor kept."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from auditlake.llm.queries import WORD_TOKENIZER, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row long, key string, score double, hash long, fp long, node long, label int, copies int"


def make():
    """Clean documents with copies and near copies, toxic ones, nulls, empty and long texts; columns that operators use too."""
    r = random.Random(23)
    words = [a + b for a in "ba ke lo mi nu ra si to du fe".split() for b in "ten dor vel ing sha mur".split()]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts, toxic = {}, set()
    for i in range(140):
        own = text(r.choice([12, 30, 60])).split()
        if i % 3 == 0:
            for term in r.sample(["grunfling", "blargwit", "snarkpoot"], 2):
                own.insert(r.randrange(len(own)), term)
            toxic.add(i)
        texts[i] = " ".join(own)
    base = text(120).split()
    for i in range(200, 206):  # one word of 120 differs
        texts[i] = " ".join([*base[: i - 195], "other", *base[i - 194 :]])
    texts |= {206: texts[1], 207: f"  {texts[1]}".replace(" ", "\n "), 208: texts[1].upper(), 209: None, 210: "", 211: " \t ", 212: "one two", 213: "one  two", 214: text(3000), 215: "Straße " * 40, 216: texts[4] + " end"}
    rows = [(i, t, ("en", "de", None)[i % 3], (f"s{i % 4}" if i % 5 else None), None if i % 7 == 0 else i, "x", i, None, 0.9, 1, 2, 3, 4, 5) for i, t in texts.items()]
    labels = [(i, 1, int(i in toxic)) for i in range(140)]
    return rows + [rows[2]], labels, toxic


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before and after each stage, as the tool writes and reads them."""
    folder, (rows, labels, toxic) = tmp_path_factory.mktemp("pipeline"), make()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {"documents": rows}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(folder))
        if name != "packing":
            assert made.columns == docs.columns, name
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out[name] = [tuple(r) for r in docs.collect()] if name != "packing" else docs.collect()
    assert corpus_pipeline.run(spark, str(folder)).count() == len(out["packing"])
    return out, toxic


def ids(rows):
    return Counter(r[0] for r in rows)


def normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    out, toxic = stages
    kept = ids(out["toxicity"])
    assert set(ids(out["documents"])) - set(kept) == toxic and kept[2] == 2
    assert Counter(map(repr, out["toxicity"])) == Counter(repr(r) for r in out["documents"] if r[0] not in toxic)


def test_equal_texts_leave_the_smallest_id(stages):
    out, _ = stages
    least = {}
    for r in out["toxicity"]:
        k = normal(r[1])
        least[k] = min(least.get(k, r[0]), r[0])
    assert ids(out["exact_dedup"]) == Counter(least.values()) and {209, 211, 212} <= set(least.values())


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    words = [w for w in normal(" ".join(words)).split(" ") if w]
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_leave_the_smallest_id(stages):
    out, _ = stages
    own = {r[0]: shingles(r[1]) for r in out["exact_dedup"]}
    parent = {i: i for i in own}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in own:
        for b in own:
            if a < b and own[a] and 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {i for i in own if root(i) == i}
    assert set(ids(out["near_dedup"])) == want and set(range(201, 206)) & want == set() and 200 in want


def test_mix_meets_its_targets(stages):
    out, _ = stages
    size = lambda r: len([w for w in normal(r[1]).split(" ") if w])
    sizes, taken, copies = defaultdict(int), defaultdict(int), ids(out["source_mix"])
    for r in out["near_dedup"]:
        sizes[r[3]] += size(r)
        taken[r[3]] += size(r) * copies[r[0]]
        assert copies[r[0]] <= 2 and (size(r) or copies[r[0]] == 1)
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        rest, weight = total - sum(target.values()), sum(weights[s] for s in open_)
        full = {s for s in open_ if rest * weights[s] / weight > 2 * sizes[s]}
        if not full:
            target |= {s: rest * weights[s] / weight for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in full}
        open_ -= full
    smallest = {s: min(size(r) for r in out["near_dedup"] if r[3] == s and size(r)) for s in names}
    assert all(abs(taken[s] - target[s]) <= max(0.02 * target[s], smallest[s]) for s in names), (dict(taken), target)
    columns = {repr(r) for r in out["near_dedup"]}
    assert {repr(r) for r in out["source_mix"]} <= columns


def test_packing_holds_every_copy(stages):
    from tokenizers import Tokenizer

    out, _ = stages
    tokenizer, want = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER)), Counter()
    for r in out["source_mix"]:
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1
        for k, at in enumerate(range(0, n, 4096)):
            want[(r[0], k, at, min(4096, n - at))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length) for r in out["packing"]) == want
    bins = defaultdict(list)
    for r in out["packing"]:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        ends = np.cumsum([0, *(n for _, n in sorted(own))]).tolist()
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
