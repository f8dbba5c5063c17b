"""Toxicity scores from a learnt lexicon, fuzzy matching and context windows.

The lexicon and the weights are fitted on a bounded sample of labelled rows. Every word of a text runs through one
automaton: the intersection of the Levenshtein automata of bounded distance with the trie of the lexicon, made
deterministic state by state as words need it. A word that clean labelled texts use is never a misspelling. Around
each match a window of words is searched for signs of quotation or of speaking about a word; matches with such signs
are counted apart from direct ones, and a logistic model weighs the counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import claim, cut, keeps, slices, texts

#: Most labelled rows that are used for fitting: those whose id hashes smallest.
SAMPLE_ROWS = 20_000
#: Share of the toxic sample texts that a term or stem must occur in, and least number of them.
TERM_SHARE, TERM_TEXTS = 0.02, 3
#: Least log odds of a term and of a stem, less their standard error. How many there are is bounded by the sample: each is
#: in a share of its toxic texts.
TERM_ODDS, STEM_ODDS = 2.6, 1.2
#: Lengths of stems, different endings that a stem must have been seen with, and most words of one text that count for it.
STEM_LENGTHS, STEM_ENDINGS, STEM_WORDS = range(3, 9), 4, 8
#: Words on either side of a match that are searched for signs of quotation.
WINDOW = 6
#: Labels of ids with this remainder are held out.
MODULUS, HELD_OUT = 4, 2
#: Words whose matches a worker keeps, and states of the automaton.
MAX_WORDS, MAX_STATES = 400_000, 50_000
#: The weights before any data: bias, direct exact, direct fuzzy, quoted exact, quoted fuzzy, share of matched words.
PRIOR = (-3.0, 4.0, 2.5, 1.0, 0.5, 1.0)
RIDGE = 0.5

#: Signs that a word is mentioned rather than used. Fixed values.
MENTION = frozenset("said says say called calls word words term terms quote quoted quotes quoting wrote writes insult insults slur slurs".split())
QUOTES = "\"'“”„«»‘’‚‹›`"
#: Digits and signs that stand for letters. Fixed values.
LEET = str.maketrans("013457@$!", "oieastasi")


def edits_for(term: str) -> int:
    """Errors that a word may have: short words are too close to others."""
    return 0 if len(term) < 5 else 1 if len(term) < 8 else 2


class FuzzyLexicon:
    """Levenshtein automata over a trie of terms, determinised lazily. A state is a set of (trie node, errors)."""

    def __init__(self, terms: list[str], stems: tuple[str, ...] = ()):
        self.stems = frozenset(stems)
        self.lengths = sorted({len(x) for x in stems})
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.most = [0]  # errors allowed by the most tolerant term below a node
        for t in terms:
            at = 0
            self.most[0] = max(self.most[0], edits_for(t))
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                at = self.children[at][c]
                self.most[at] = max(self.most[at], edits_for(t))
            self.term[at] = t
        self.states: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.start = self.state({0: 0})

    def state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # a missing letter takes no input
            n = todo.pop()
            for k in self.children[n].values():
                if (e := nodes[n] + 1) <= self.most[k] and e < nodes.get(k, 99):
                    nodes[k] = e
                    todo.append(k)
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(nodes)
            self.moves.append({})
            found = [(e, self.term[n]) for n, e in nodes.items() if n in self.term and e <= edits_for(self.term[n])]
            self.ends.append((min(found)[1], min(found)[0]) if found else None)
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def put(n: int, e: int) -> None:
            if e <= self.most[n] and e < nodes.get(n, 99):
                nodes[n] = e

        for n, e in self.sets[state].items():
            put(n, e + 1)
            for x, k in self.children[n].items():
                put(k, e + (x != c))
        new = self.moves[state][c] = self.state(nodes) if nodes else -1
        return new

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a word is, else the stem that it begins with, else the nearest term within its errors; and the errors."""
        hit = self.near(word)
        if hit and not hit[1]:
            return hit
        return next(((word[:n], 0) for n in self.lengths if word[:n] in self.stems), hit)

    def near(self, word: str) -> tuple[str, int] | None:
        if len(self.sets) > MAX_STATES:
            self.states.clear(), self.sets.clear(), self.moves.clear(), self.ends.clear()
            self.start = self.state({0: 0})
        at, moves = self.start, self.moves
        for c in word:
            new = moves[at].get(c)
            at = self.step(at, c) if new is None else new
            if at < 0:
                return None
        return self.ends[at]


_SHARED: dict = {}
keeps("toxicity", _SHARED.clear)


@dataclass
class ToxicityModel:
    weights: dict[str, float]  # terms and stems, and their log odds
    stems: tuple[str, ...] = ()
    clean: frozenset[str] = frozenset()  # words near a term which clean texts use
    coefficients: tuple[float, ...] = PRIOR
    both: frozenset[str] = frozenset()  # stems that are terms too
    cache: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def __setstate__(self, state: dict) -> None:
        # In a worker, tasks with the same lexicon share what has been looked up.
        name = (tuple(sorted(state["weights"].items())), state["stems"], state["clean"], state["both"])
        if _SHARED.get("name") != name:
            _SHARED.clear()
            _SHARED.update(name=name, cache={})
        self.__dict__.update(state, cache=_SHARED["cache"])

    def lookup(self, word: str) -> tuple[str, int] | None:
        """The term that a word is or misspells, and the errors."""
        lexicon = self.cache.get("lexicon")
        if lexicon is None:
            lexicon = self.cache["lexicon"] = FuzzyLexicon(sorted(self.weights.keys() - set(self.stems) | self.both), self.stems)
        if word in self.clean:
            return None
        if found := lexicon.match(word):
            return found
        plain = word.translate(LEET)
        if plain == word or word.isdigit() or not plain.isalpha():
            return None
        return None if plain in self.clean else lexicon.match(plain)

    def features(self, text: str) -> list[float]:
        """Direct exact, direct fuzzy, quoted exact, quoted fuzzy (each log1p of a weighted count), share of matched words."""
        known = self.cache.setdefault("known", {})
        # Marks that may stand for letters stay inside words; all else splits.
        words = text.lower().translate(SPLIT).split()
        if len(known) > MAX_WORDS:
            known.clear()
        found = list(map(known.get, words, repeat(False)))
        if False in found:
            for i, hit in enumerate(found):
                if hit is False:
                    w = words[i]
                    if w not in known:
                        known[w] = self.lookup(w)
                    found[i] = known[w]
        if not any(found):
            return [0.0] * 5
        sums, n = [0.0] * 4, 0
        for i, hit in enumerate(found):
            if hit:
                n += 1
                near = words[max(0, i - WINDOW) : i + WINDOW + 1]
                quoted = not MENTION.isdisjoint(near)
                sums[2 * quoted + (hit[1] > 0)] += min(1.0, self.weights[hit[0]] / 5) / (1 + hit[1])
        if quoted_words := self.quoted(text):
            # Matches inside quotation marks move from the direct to the quoted count.
            for w in quoted_words:
                if (hit := known.get(w)) and sums[x := int(hit[1] > 0)] > 0:
                    moved = min(sums[x], min(1.0, self.weights[hit[0]] / 5) / (1 + hit[1]))
                    sums[x] -= moved
                    sums[2 + x] += moved
        return [*(math.log1p(3 * s) for s in sums), min(1.0, 10 * n / len(words))]

    @staticmethod
    def quoted(text: str) -> list[str]:
        return [w for m in QUOTED.finditer(text.lower()) for w in m.group(1).translate(SPLIT).split()]

    def score(self, text: str) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


class _Split(dict):
    """Characters between words become spaces: all but letters, digits and signs that stand for letters."""

    def __missing__(self, c: int) -> int:
        x = self[c] = c if chr(c).isalnum() or chr(c) in "@$" else 32
        return x


SPLIT = _Split()
#: A span between quotation marks on one line that begins and ends at words; an apostrophe within a word is no mark.
QUOTED = re.compile(rf"(?:(?<=\s)|^)[{QUOTES}]((?:[^\n{QUOTES}]|(?<=\w)['’](?=\w))++)[{QUOTES}](?=[\s.,;:!?)]|$)")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """label, text of at most `rows` labelled documents outside the held-out part.

    Labels other than 0 and 1 and null ids take no part; of labels that differ for one id, the greater counts. A null text
    counts as empty. Of texts with one label and one sketch (the least hash of five words), that of the smallest id and
    least text counts, for all of them: copies would make rare words look certain. Other columns are not read; empty
    tables give an empty sample.
    """
    key = F.col(id_col).cast("long")
    usable = labels.select(key.alias("__id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and __id is not null")
    usable = usable.where(F.crc32(F.col("__id").cast("string")) % MODULUS != HELD_OUT).groupBy("__id").agg(F.max("label").alias("label"))
    # The bound makes this small enough to send to every executor.
    chosen = usable.orderBy(F.xxhash64("__id"), "__id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sketch = []
            for t in texts(b.column(2)):
                w = t.lower().split()
                sketch.append(min((xxhash.xxh64_intdigest(" ".join(w[i : i + 5])) >> 1 for i in range(max(1, len(w) - 4))), default=0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sketch, pa.int64())], names=["id", "label", "text", "sketch"])

    own = docs.select(key.alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id").select(F.col("__id").alias("id"), "label", F.coalesce("text", F.lit("")).alias("text"))
    first = F.min(F.struct("id", "text")).alias("first")
    return cut(own.mapInArrow(run, "id long, label int, text string, sketch long").groupBy("label", "sketch").agg(first).select("label", "first.text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learns terms, stems, clean neighbours and weights from labelled_sample, whose docstring tells which rows count.

    Without labels of both kinds the prior weights and no terms remain. What comes to the driver (terms, stems, words near
    them, features of the sample) is bounded by the sample. The result doesn't depend on the order or partitions of rows.
    """
    sample = labelled_sample(docs, labels, rows, id_col, text_col, label_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        seen: dict[tuple[bool, str], list[int]] = {}
        for b in slices(batches):
            for y, t in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                words = set(t.lower().translate(SPLIT).split())
                stems = Counter(w[:n] for w in words for n in STEM_LENGTHS if n < len(w))
                for key, n in [*(((False, w), 1) for w in words), *(((True, x), n) for x, n in stems.items())]:
                    own = seen.setdefault(key, [0, 0, 0, 0])
                    own[y] += 1
                    own[2 + y] += min(n, STEM_WORDS)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.bool_()), pa.array([k[1] for k in seen], pa.string()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4))], names=["stem", "word", *numbers])

    size = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(size) < 2:
        return ToxicityModel({})
    # Texts with a word or stem, and words with it; of either label.
    numbers = ["clean", "toxic", "clean_words", "toxic_words"]
    counts = cut(sample.mapInArrow(count, "stem boolean, word string, " + ", ".join(f"{n} long" for n in numbers)).groupBy("stem", "word").agg(*(F.sum(n).alias(n) for n in numbers)), "word-counts")
    all_words = counts.where("not stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).first()
    of_texts = F.log((F.col("toxic") + 0.5) / (size[1] + 1)) - F.log((F.col("clean") + 0.5) / (size[0] + 1))
    of_words = F.log((F.col("toxic_words") + 0.5) / ((all_words["toxic"] or 0) + 1)) - F.log((F.col("clean_words") + 0.5) / ((all_words["clean"] or 0) + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    least = max(TERM_TEXTS, TERM_SHARE * size[1])
    strong = counts.withColumn("odds", F.when(F.col("stem"), of_words).otherwise(of_texts)).withColumn("sure", F.col("odds") - error)
    strong = strong.where((F.col("toxic") >= least) & (F.col("sure") >= F.when(F.col("stem"), STEM_ODDS).otherwise(TERM_ODDS)))
    terms = strong.where("not stem and length(word) >= 3").collect()
    weights, whole = {r["word"]: r["odds"] for r in terms}, {r["word"]: r["toxic"] for r in terms}
    words = counts.where("not stem and toxic > 0").select("word")
    endings = words.select(F.explode(F.transform(F.sequence(F.lit(STEM_LENGTHS[0]), F.lit(STEM_LENGTHS[-1])), lambda n: F.when(n < F.length("word"), F.expr("word").substr(F.lit(1), n)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("endings"))
    found = strong.where("stem").join(endings.where(F.col("endings") >= STEM_ENDINGS), "word").select("word", "odds", "sure", "toxic").collect()
    stems: dict[str, float] = {}
    # The surest stem of a family stands for it; in a tie the longer one.
    for r in sorted(found, key=lambda r: (-r["sure"] * math.sqrt(r["toxic"]), -len(r["word"]), r["word"])):
        x = r["word"]
        related = any(x.startswith(s) or s.startswith(x) for s in stems)
        if not related and not any(w.startswith(x) and n >= 0.8 * r["toxic"] for w, n in whole.items()):
            stems[x] = r["odds"]
    # Terms that a stem covers stay in the trie, for misspellings within the stem.
    both = frozenset(weights.keys() & stems.keys())
    weights |= stems
    model = ToxicityModel(weights, tuple(stems), both=both)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(hit := model.lookup(w)) is not None and hit[1] > 0 for w in b.column(0).to_pylist()]
            yield b.select(["word"]).filter(pa.array(keep, pa.bool_()))

    # Only words of clean sample texts that the automaton takes for a term: bounded with the sample.
    clean = counts.where(~F.col("stem") & (F.col("clean") > 0) & (F.col("clean") / size[0] >= F.col("toxic") / size[1])).select("word", "clean").mapInArrow(near, "word string")
    model = ToxicityModel(weights, tuple(stems), frozenset(r["word"] for r in clean.collect()), both=both)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.features(t) for t in texts(b.column(1))], pa.list_(pa.float64()))], names=["label", "x"])

    got = sample.mapInArrow(measure, "label int, x array<double>").collect()
    x = np.array([[1.0, *r["x"]] for r in got])
    y = np.array([r["label"] for r in got], float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of rows
    return ToxicityModel(weights, model.stems, model.clean, tuple(logistic(x[order], y[order])), both)


def logistic(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = PRIOR, ridge: float = RIDGE) -> list[float]:
    """Newton's method for the penalised likelihood around the prior weights."""
    w = np.array(prior)
    pull = np.full(len(w), ridge)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(v), 9) for v in w]


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs.

    A null or empty text has no matches and gets the score of such texts. A null id is not held out. Repeated rows
    give repeated results; other columns, the label among them, are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for b in slices(batches):
            s = [model.score(t) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    key = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(key.cast("string")) % MODULUS == HELD_OUT, F.lit(False))
    return docs.select(key.alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns, whatever their names.

    Each row is judged by itself: repeated rows stay or go together. A null or empty text stays as it is unless the model
    scores the empty text at the threshold or more. An empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        for b in slices(batches):
            yield b.filter(pa.array([model.score(t) < threshold for t in texts(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
