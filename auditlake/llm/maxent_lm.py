"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(subclass | class, history) * P(word | subclass). Words of the head are put into
classes by frequency, with about equal shares of its tokens, and these likewise into subclasses; all other words are one
more class, with subclasses by hash. Both softmaxes have hashed features of the history (the last word, the last two words,
and the word before the last alone, a skip), in the second joined with the class. Every word has features of its own as a
history, those outside the head too. The number of hashed rows grows with the number of different words in the training
texts. The weights are trained by distributed gradient updates: in each round every partition runs adaptive gradient
steps over its share of the documents from the common weights, and the weights are averaged by tokens. The softmax within
a subclass has one feature for each word, whose best weights are known in closed form.

Counts of all words stay distributed. The head, of bounded size, is sent to executors; words outside it meet their counts
in a join. Texts are read twice, for the counts and to be written as codes; all later passes read the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import byte_slices, claim, cut, keeps, slices, text_bytes

#: Documents whose id hashes to this remainder are held out.
MODULUS, HELD_OUT = 7, 2
#: Most words of the head; classes, the last of which is of all other words, and subclasses of each.
HEAD_WORDS, CLASSES, SUBCLASSES = 200_000, 16, 16
#: Kinds of features: three of each softmax.
KINDS = 6
#: Different training words for each row of weights of a feature kind; least and most rows, which bound a worker's memory at 200 MB.
WORDS_A_ROW, LEAST_ROWS, MOST_ROWS = 64, 1 << 12, 1 << 18
#: Bias of what never occurs.
NEVER = -60.0
#: Size of logits whose exponentials single precision holds with a wide margin.
MOST_PLAIN = 75.0
#: Rounds of updates; each uses another part of the training documents, together all of them.
ROUNDS = 2
#: Tokens of a gradient step, and its size.
STEP_TOKENS, RATE = 1 << 14, 0.4
#: Sum of squared gradients that each weight begins with: the more, the less a history that is seen few times says.
FIRST_SQUARES = 16.0
#: Bytes of text whose words are counted before they are passed on, and of texts that become codes together.
COUNTED_BYTES, SLICE_BYTES = 12 << 20, 4 << 20
#: Parts in which weights travel, and lists that one merge takes.
BLOCKS, FAN_IN = 16, 64
#: Tokens that a list of weights stands for at least, and no fewer than it has weights: so lists stay smaller than the texts.
LIST_TOKENS = 4_000_000

#: The token that ends a text; no word has a newline.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def words_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The words of all texts one behind the other, without the tokens that end texts, and where each text's begin and the last's end."""
    # Not by pc.ascii_lower: that of Arrow 23 takes other bytes for those of a slice.
    split = pc.ascii_split_whitespace(pa.array((t.lower() for t in text_bytes(texts)), pa.large_binary()).view(pa.large_string()))
    # White space at a text's ends makes empty words.
    words, true = split.values, pc.not_equal(split.values, "")
    return words.filter(true), np.append(0, np.cumsum(true.to_numpy(zero_copy_only=False)))[split.offsets.to_numpy()]


def remainder(id_col: Column, modulus: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus, F.lit(-1))


def word_counts(texts: DataFrame) -> DataFrame:
    """word, c over all rows of texts (column text), written to the shared folder."""

    def counted(column: pa.Array) -> pa.RecordBatch:
        found = pc.value_counts(words_of(column)[0])
        word = pa.concat_arrays([found.field(0), pa.array([END.decode()], pa.large_string())])
        return pa.RecordBatch.from_arrays([word.cast(pa.string()), pa.concat_arrays([found.field(1), pa.array([len(column)], pa.int64())])], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in byte_slices(batches, 0, COUNTED_BYTES):
            held.append(b.column(0))
            size += b.column(0).nbytes
            if size > COUNTED_BYTES * 3 // 4:
                yield counted(pa.concat_arrays(held))
                held, size = [], 0
        if held:
            yield counted(pa.concat_arrays(held))
        held = None
        # A worker goes on to train, which needs its memory.
        pa.default_memory_pool().release_unused()

    return cut(texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")


class Head:
    """The most frequent words with counts, classes and subclasses, and what is known of all other words."""

    def __init__(self, words: list[bytes], counts: np.ndarray, all_tokens: int, all_words: int, rest: np.ndarray, classes: int = CLASSES, subclasses: int = SUBCLASSES):
        """rest: tokens and words outside the head, two numbers for each subclass."""
        order = sorted(range(len(words)), key=lambda i: (-int(counts[i]), words[i]))
        self.words = [words[i] for i in order]
        self.counts = counts[order].astype(np.int64)
        self.all_tokens, self.all_words, self.classes, self.subclasses = all_tokens, all_words, classes, subclasses
        share = np.cumsum(self.counts) / max(1, self.counts.sum())
        cell = np.minimum((share - 1e-12) * (classes - 1) * subclasses, (classes - 1) * subclasses - 1).astype(np.int64)
        self.cell = cell  # class * subclasses + subclass
        mass = np.bincount(cell, self.counts + 1, classes * subclasses)
        # In the last class, with one place for a word never seen in each subclass.
        mass[-subclasses:] = rest.sum(axis=1) + 1
        self.log_mass = np.log10(np.maximum(mass, 1))
        tokens = np.bincount(cell, self.counts, classes * subclasses).astype(float)
        tokens[-subclasses:] = rest[:, 0]
        tokens = tokens.reshape(classes, subclasses)
        of_class = tokens.sum(axis=1)
        self.bias = np.log((of_class + 0.5) / (of_class.sum() + 0.5 * classes)).astype(np.float32)
        self.sub_bias = np.log((tokens + 0.5) / (of_class[:, None] + 0.5 * subclasses)).astype(np.float32)
        # A frequent word may leave classes and subclasses after its own without words: they get no probability.
        none = (mass == 0).reshape(classes, subclasses)
        self.bias[none.all(axis=1)] = NEVER
        self.sub_bias[none] = NEVER

    def index(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def cells(self, codes: np.ndarray) -> np.ndarray:
        """Class * subclasses + subclass of each token."""
        n = len(self.words)
        known = codes < n
        rest = (self.classes - 1) * self.subclasses + (codes - n) % self.subclasses
        return np.where(known, self.cell[np.where(known, codes, 0)], rest) if n else rest

    def log_in_cell(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """log10 of the closed form within the subclass; of a word outside the head, without the log of its count."""
        counts = np.where(codes < len(self.words), np.r_[self.counts, 0][np.minimum(codes, len(self.words))], 0)
        return np.log10(counts + 1.0) - self.log_mass[cells]


def rows_for(words: int) -> int:
    """Rows of weights of each feature kind for so many different training words."""
    return min(MOST_ROWS, max(LEAST_ROWS, 1 << max(0, words // WORDS_A_ROW - 1).bit_length()))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def histories(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of each token's last word, last two words, and word before the last. codes: of joined texts."""
    n = len(codes)
    one, two = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    one[1:], two[2:] = codes[:-1], codes[:-2]
    one[starts], two[starts] = -1, -1
    second = starts[starts + 1 < n] + 1
    two[second] = -1
    # Of texts of one token the next text's first token was just marked; it has no history either way.
    a = mixed((one + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    b = mixed((two + 2).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.stack([a, mixed(a + (b ^ (b >> np.uint64(31)))), b])


def features(hashes: np.ndarray, buckets: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Rows of weights of each kind of history; with classes, those of histories joined with a class, behind the others."""
    if classes is not None:
        hashes = mixed(hashes + (classes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    kinds = np.arange(3)[:, None] + (3 if classes is not None else 0)
    # buckets is a power of two.
    return ((hashes >> np.uint64(20)) & np.uint64(buckets - 1)).astype(np.int64) + kinds * buckets


def taken(table: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The first n columns of rows of a table."""
    out = table.take(rows, axis=0)
    return out if n == table.shape[1] else out[:, :n]


def shift(z: np.ndarray) -> None:
    """Takes each row's largest from it, unless all numbers are such that the sums of their exponentials hold."""
    if z.size and (z.max() > MOST_PLAIN or z.min() < -MOST_PLAIN):
        z -= z.max(axis=1, keepdims=True)


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = bias.shape[-1]
    z = taken(weights, rows[0], n) + bias
    for kind in rows[1:]:
        z += taken(weights, kind, n)
    return z


def log_probability(z: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural logs of the softmax at the classes given; z is used up."""
    shift(z)
    own = z[np.arange(len(z)), classes]
    return own - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


def log_scores(head: Head, weights: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of each token's probability; of a word outside the head, without the log of its count plus one."""
    hashes, cells, buckets = histories(codes, starts), head.cells(codes), len(weights) // KINDS
    out = head.log_in_cell(codes, cells)
    for at in range(0, len(codes), STEP_TOKENS):
        s = slice(at, at + STEP_TOKENS)
        h, (c, sub) = hashes[:, s], divmod(cells[s], head.subclasses)
        found = log_probability(logits(weights, head.bias, features(h, buckets)), c)
        found = found + log_probability(logits(weights, head.sub_bias[c], features(h, buckets, c)), sub)
        out[s] += found / np.log(10)
    return out


def step(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, rows: np.ndarray, goal: np.ndarray, rate: float) -> None:
    """One adaptive gradient step of a softmax."""
    n = bias.shape[-1]
    met = [taken(weights, kind, n) for kind in rows]
    p = met[0] + bias
    for x in met[1:]:
        p += x
    shift(p)
    np.exp(p, out=p)
    p /= (p @ np.ones(n, p.dtype))[:, None]
    p[np.arange(len(goal)), goal] -= 1
    for kind, x in zip(rows, met, strict=True):
        order = np.argsort(kind.astype(np.int32))
        own = kind.take(order)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        used, times, at = own.take(first), np.diff(first, append=len(own)), order.take(first)
        # Most rows are met once; only the others need sums.
        g, more = p.take(at, axis=0), times > 1
        if more.any():
            g[more] = np.add.reduceat(p.take(order[np.repeat(more, times)], axis=0), np.cumsum(times[more]) - times[more], axis=0)
        g /= np.sqrt(times.astype(np.float32))[:, None]
        seen = taken(squares, used, n)
        seen += g * g
        squares[used, :n] = seen
        np.sqrt(seen, out=seen)
        g *= rate
        g /= seen
        weights[used, :n] = x.take(at, axis=0) - g


class Codes(dict):
    """Codes of words: the place in the head, or behind it 30 bits of the word's hash, the lowest of which name the subclass."""

    def __init__(self, head: Head):
        super().__init__(head.index())
        self.size = len(head.words)

    def __missing__(self, word: bytes) -> int:
        return self.size + (xxhash.xxh64_intdigest(word, 42) & (1 << 30) - 1)


_KEPT: dict = {}
keeps("maxent_lm", _KEPT.clear)


def opened(sent) -> tuple[Head, Codes]:
    """The head of a broadcast, with its index made once in a worker."""
    claim("maxent_lm")
    if _KEPT.get("of") is not sent.value:
        _KEPT.update(of=sent.value, codes=Codes(sent.value))
    return sent.value, _KEPT["codes"]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the texts of a batch, and where each text starts."""
    own = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    return np.concatenate(own).astype(np.int64), np.cumsum([0, *map(len, own)])[:-1]


def encode(docs: DataFrame, head_sent, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, part (of the training), held_out, n_tokens, known, logs, codes, tail (words outside the head) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, codes = opened(head_sent)
        logs, size = np.log10(np.r_[head.counts + 1.0, 1.0]), len(head.words)
        for b in byte_slices(batches, 4, SLICE_BYTES):
            words, offsets = words_of(b.column(4))
            words = words.dictionary_encode()
            different = pa.concat_arrays([words.dictionary, pa.array([END.decode()], pa.large_string())])
            of = np.fromiter(map(codes.__getitem__, different.view(pa.large_binary()).to_pylist()), np.int32, len(different))
            # Each text's end token stands behind its words.
            stops = offsets[1:] + np.arange(1, b.num_rows + 1)
            starts, inner = np.append(0, stops[:-1]), np.ones(stops[-1], bool)
            inner[stops - 1] = False
            places = np.full(len(inner), len(different) - 1, np.int32)
            places[inner] = words.indices.to_numpy()
            own = of.take(places)
            rest = own >= size
            in_rest = np.append(0, np.cumsum(rest))[np.append(0, stops)]
            tail = pa.ListArray.from_arrays(pa.array(in_rest, pa.int32()), different.take(pa.array(places[rest])).cast(pa.string()))
            kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(pa.array(4 * np.append(0, stops), pa.int32()).to_numpy()), pa.py_buffer(own)])
            sums = np.add.reduceat(logs.take(np.minimum(own, size)), starts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(stops - starts), pa.array(stops - starts - np.diff(in_rest)), pa.array(sums), kept, tail], names=["doc_id", "row", "part", "held_out", "n_tokens", "known", "logs", "codes", "tail"])
        pa.default_memory_pool().release_unused()

    key = F.col(id_col).cast("long")
    held = remainder(key, MODULUS) == HELD_OUT
    own = docs.select(key.alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.pmod(F.xxhash64(key, F.length(text_col)), F.lit(ROUNDS)).alias("part"), held.alias("held_out"), F.col(text_col).alias("text"))
    return cut(own.mapInArrow(run, "doc_id long, row long, part long, held_out boolean, n_tokens long, known long, logs double, codes binary, tail array<string>"), "codes")


def lists_for(all_tokens: int, weights: int, cores: int) -> int:
    """How many parts of the texts are trained apart: one for each core, and more as the tokens allow."""
    return max(1, cores, all_tokens // max(LIST_TOKENS, weights))


def train(codes: DataFrame, head_sent, weights: np.ndarray, tokens_here: int, rate: float = RATE, first_squares: float = FIRST_SQUARES) -> np.ndarray:
    """One round: adaptive gradient steps in each part of the texts (column codes, about so many tokens), then the average of the weights by tokens."""
    spark = codes.sparkSession
    sent = spark.sparkContext.broadcast(weights)
    rows_in_block, buckets = -(-len(weights) // BLOCKS), len(weights) // KINDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, _ = opened(head_sent)
        own, squares, n = sent.value.copy(), np.full(sent.value.shape, first_squares, np.float32), 0
        for b in slices(batches, 64):
            ids, starts = joined(b.column(0))
            hashes, cells = histories(ids, starts), head.cells(ids)
            for at in range(0, len(ids), STEP_TOKENS):
                h, (c, sub) = hashes[:, at : at + STEP_TOKENS], divmod(cells[at : at + STEP_TOKENS], head.subclasses)
                step(own, squares, head.bias, features(h, buckets), c, rate)
                step(own, squares, head.sub_bias[c], features(h, buckets, c), sub, rate)
            n += len(ids)
        if n:
            # Half precision on the way: a weight's own steps are far coarser.
            parts = [own[i * rows_in_block : (i + 1) * rows_in_block].astype(np.float16).tobytes() for i in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([float(n)] * BLOCKS), pa.array(parts, pa.binary())], names=["block", "n", "data"])

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["data"].iloc[0]) // 2, np.float64)
        for x, n in zip(rows["data"], rows["n"], strict=True):
            total += np.frombuffer(x, np.float16).astype(np.float64) * n
        n = rows["n"].sum()
        return pd.DataFrame({"block": rows["block"].iloc[:1], "n": [n], "data": [(total / n).astype(np.float16).tobytes()], "list": rows["list"].iloc[:1]})

    n = lists_for(tokens_here, weights.size, spark.sparkContext.defaultParallelism)
    lists = codes.select("codes").coalesce(n).mapInArrow(run, "block int, n double, data binary").withColumn("list", F.spark_partition_id())
    # Level by level, so that no task takes more than FAN_IN lists of a block, however many there are.
    while True:
        n = -(-n // FAN_IN)
        lists = lists.withColumn("list", F.expr(f"list div {FAN_IN}")).groupBy("block", "list").applyInPandas(average, "block int, n double, data binary, list long")
        if n == 1:
            break
    got = lists.collect()
    sent.unpersist()
    out = weights.copy()
    for r in got:
        x = np.frombuffer(r["data"], np.float16).astype(np.float32).reshape(-1, weights.shape[1])
        out[r["block"] * rows_in_block : r["block"] * rows_in_block + len(x)] = x
    return out


def head_of(counts: DataFrame, most: int = HEAD_WORDS, classes: int = CLASSES, subclasses: int = SUBCLASSES) -> Head:
    """The words whose count reaches the least threshold that at most `most` words reach."""
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # Counts that many words have are few; the histogram is far smaller than the vocabulary.
    least, held = 1 << 62, 0
    for c, n in counts.where("c > 1").groupBy("c").count().orderBy(F.desc("c")).limit(most).collect():
        if held + n > most:
            break
        least, held = c, held + n
    rows = counts.where(F.col("c") >= least).collect()
    rest = np.zeros((subclasses, 2), np.int64)
    # Spark's hash of a string is that of its bytes with the seed that Codes takes.
    of = counts.where(F.col("c") < least).groupBy(F.xxhash64("word").bitwiseAND(F.lit((1 << 30) - 1)).alias("h") % subclasses)
    for s, n, v in of.agg(F.sum("c"), F.count(F.lit(1))).collect():
        rest[s] = n, v
    return Head([r["word"].encode() for r in rows], np.array([r["c"] for r in rows], np.int64), int(sums["n"] or 0), sums["v"], rest, classes, subclasses)


def score_texts(docs: DataFrame, rounds: int = ROUNDS, head_words: int = HEAD_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row for each row of docs.

    Learns from all documents that aren't held out, each in one of the rounds. n_known counts tokens seen in training;
    base_score is the add-one unigram log10 probability, score the model's. A null text counts as empty: its end token
    alone is scored. A null id isn't held out. Without training documents every token is unknown. Repeated rows give
    repeated results; other columns are not read. An empty table gives an empty result.
    """
    counts = word_counts(docs.where(remainder(F.col(id_col).cast("long"), MODULUS) != HELD_OUT).select(F.col(text_col).alias("text")))
    head = head_of(counts, head_words)
    context = docs.sparkSession.sparkContext
    head_sent = context.broadcast(head)
    coded = encode(docs, head_sent, id_col, text_col)
    weights = np.zeros((KINDS * rows_for(head.all_words), max(head.classes, head.subclasses)), np.float32)
    for turn in range(rounds):
        weights = train(coded.where(f"not held_out and part % {rounds} = {turn}"), head_sent, weights, head.all_tokens // rounds)
    sent = context.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, _ = opened(head_sent)
        for b in slices(batches, 64):
            if b.num_rows:
                codes, starts = joined(b.column(6))
                total = np.add.reduceat(log_scores(head, sent.value, codes, starts), starts)
                yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(total)], names=["doc_id", "row", "held_out", "n_tokens", "known", "logs", "model"])

    # The logs of the counts of words outside the head come from a join.
    rest = coded.select("row", F.explode("tail").alias("word"))
    found = rest.join(counts, "word").groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log10(F.col("c") + 1)).alias("l"))
    model = coded.select("doc_id", "row", "held_out", "n_tokens", "known", "logs", "codes").mapInArrow(run, "doc_id long, row long, held_out boolean, n_tokens long, known long, logs double, model double")
    base = -np.log10(head.all_tokens + head.all_words + 1)
    logs = F.coalesce("l", F.lit(0.0))
    return model.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n", F.lit(0))).cast("long").alias("n_known"), F.lit(head.all_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + logs + F.col("n_tokens") * F.lit(float(base))).alias("base_score"), (F.col("model") + logs).alias("score"),
    )
