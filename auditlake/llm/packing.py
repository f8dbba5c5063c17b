"""Packing token sequences into bins of fixed size by bin completion, on the histogram of lengths.

Only lengths matter for a packing, and there are at most `capacity` of them, so the search runs on the histogram,
whose size doesn't depend on the number of documents. A pattern is a filling (a multiset of lengths) used a number of
times. The incumbent is best-fit decreasing with multiplicities. Where it misses the lower bound, a dive packs all of
the histogram, each bin with the fullest filling that there is. Bin completion then takes the largest remaining length,
enumerates its undominated fillings (those which no swap of items for a larger item that fits improves), uses each as
often as supplies allow, and backtracks; branches whose waste already exceeds what the incumbent may waste are pruned.
Documents take their places by rank among those of equal length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import byte_slices, claim, cut, keeps, text_bytes

CAPACITY = 4096
#: Id that ends each document.
END_ID = 1
#: Words whose ids a worker keeps; the memory of a full table is about 200 MB.
MAX_WORDS = 900_000
#: Longer words are encoded when met and not kept.
MAX_WORD = 48
#: Bytes of text whose different words are looked up together; a longer text is one such part.
SLICE_BYTES = 16 << 20
#: Branches that the search visits beside one for each length, and fillings that it enumerates for one bin, in so many steps for each.
#: They bound time, not the result's validity, and come into play only where neither best fit nor the dive meets the lower bound; the
#: gap that they may leave is in the result (sequences less lower_bound).
MAX_NODES, MAX_FILLINGS, FILLING_STEPS = 4000, 24, 40
#: Lengths up to which what a branch leaves is completed by the dive, which takes longer, in place of best fit.
SMALL = 64
#: Pieces of one length that are ranked together; a length that has more is dealt into parts.
PART_ROWS = 500_000

Pattern = tuple[tuple[int, int], ...]  # (length, items), from the largest length down


# -- token ids --------------------------------------------------------------------------------------------------------


#: Words whose lower case and composition are plain: letters of ASCII and Latin-1.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks of ASCII: a run of them at a word's end is a unit of the merges of its own.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte in the vocabulary: its own where it is visible, else one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


#: Of all bytes but the space, which stays between words.
BYTE_LETTERS = {b: c for b, c in byte_letters().items() if b != 32}


class WordIds:
    """Ids of whole texts, from the ids of their words: the tokenizer drops white space and no merge crosses it.

    It also lower-cases, and never joins a letter with punctuation after it; so "Word.##" is found as "word" and ".##".
    Of a batch of texts, each different word is looked up once.
    """

    def __init__(self, path: str, kept_words: int = MAX_WORDS):
        # A task has one core; threads of the library's own would only wait for it.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # The merges alone, for words that the steps before them would leave as they are.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # of each id, whether it ends a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.kept_words = kept_words

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of words. Words of Latin letters alone are one unit of the merges, without the steps before them."""
        plain = [LETTERS.fullmatch(w) is not None for w in words]
        own = iter(self.encode_plain(list(compress(words, plain))))
        rest = iter(self.encode_any([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(own if p else rest) for p in plain]

    def encode_plain(self, words: list[str]) -> list[bytes]:
        lines = (" ".join(words[at : at + 256]) for at in range(0, len(words), 256))
        found = self.merges.encode_batch_fast([x.lower().encode().decode("latin-1").translate(BYTE_LETTERS) for x in lines], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(x.ids, "<u4") for x in found)])
        ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def encode_any(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def lowered(self, text: bytes) -> bytes:
        """The text in ASCII lower case.

        A text keeps its case if it has a special token's string then or before. So does a word with a combining mark,
        since the tokenizer composes before it lower-cases: a capital and its mark may have no composed form where the
        small letter has one. The marks that compose with ASCII letters are those from U+0300 to U+036F, whose first
        byte is CC or CD.
        """
        lower = text.lower()
        if any(s in lower for s in self.specials):
            return text
        if b"\xcc" in text or b"\xcd" in text:
            return b" ".join(w if b"\xcc" in w or b"\xcd" in w else w.lower() for w in text.split())
        return lower

    def units(self, words: pa.LargeStringArray) -> pa.LargeStringArray:
        """Two for each word: what stands before the marks at its end, and these marks.

        Where no small letter stands before the marks, or a special token's string may be, the word stays whole.
        """
        starts, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
        stops = starts[:-1] + pc.binary_length(pc.ascii_rtrim(words, characters=MARKS)).to_numpy()
        before = np.frombuffer(data or b"\0", np.uint8)[np.maximum(stops - 1, 0)]
        whole = (stops == starts[:-1]) | (before < ord("a")) | (before > ord("z")) | pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        cuts = np.append(np.stack([starts[:-1], np.where(whole, starts[1:], stops)], 1).ravel(), starts[-1])
        return pa.LargeStringArray.from_buffers(2 * len(words), pa.py_buffer(cuts), data)

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't known yet."""
        out = self.encode(words)
        # A full table begins anew.
        if len(self.known) + len(words) > self.kept_words:
            self.known.clear()
        self.known.update((w, x) for w, x in zip(words, out, strict=True) if len(w) <= MAX_WORD)
        return out

    def ids(self, texts: list[bytes]) -> Iterator[memoryview]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = pc.ascii_split_whitespace(pa.array(map(self.lowered, texts), pa.large_binary()).view(pa.large_string()))
        words = split.values.dictionary_encode()
        units = self.units(words.dictionary).dictionary_encode()
        different = units.dictionary.to_pylist()
        found = list(map(self.known.get, different))
        missing = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(missing, self.learn([different[i] for i in missing]), strict=True):
            found[i] = x
        of_units = pa.array(found, pa.large_binary()).take(units.indices)
        # A word's two units stand one behind the other.
        starts = np.frombuffer(of_units.buffers()[1], np.int64)[: 2 * len(words.dictionary) + 1]
        of_words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words.dictionary), [None, pa.py_buffer(starts[::2].copy()), of_units.buffers()[2]])
        _, offsets, ids = of_words.take(words.indices).buffers()
        ends = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()].tolist()
        view = memoryview(ids or b"").cast("B")
        for i, j in zip(ends, ends[1:], strict=False):
            yield view[i:j]


@lru_cache(maxsize=2)
def word_ids(path: str, kept_words: int = MAX_WORDS) -> WordIds:
    return WordIds(path, kept_words)


keeps("packing", word_ids.cache_clear)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kept_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32: every document with its end id, cut only where it is longer than capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        encode = word_ids(tokenizer_path, kept_words).ids
        end = np.array([END_ID], "<u4").tobytes()
        for b in byte_slices(batches, 2, SLICE_BYTES):
            out: list[list] = [[] for _ in range(6)]
            for d, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encode(text_bytes(b.column(2))), strict=True):
                size = len(t) + len(end)
                for k, at in enumerate(range(0, size, 4 * capacity)):
                    stop = min(at + 4 * capacity, size)
                    crc = zlib.crc32(t[at:stop])
                    for x, v in zip(out, (d, r, k, at // 4, (stop - at) // 4, zlib.crc32(end, crc) if stop == size else crc), strict=True):
                        x.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return cut(own.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long"), "pieces")


# -- the search -------------------------------------------------------------------------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: patterns and how often each is used."""
    groups: dict[int, dict[Pattern, int]] = {capacity: {}}
    space = [capacity]  # sorted free spaces that groups have; the full capacity stands for new bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_right(space, length - 1)
            free = space[at]
            if free == capacity and not groups[capacity]:
                pattern, bins, fit = (), left, capacity // length
                if fit > 1:
                    # Equal lengths share a new bin, as one after the other best fit would put them.
                    take = fit if left >= fit else left
                    bins = left // take
                    done, new = ((length, take),), free - take * length
                    left -= bins * take
                else:
                    done, new = ((length, 1),), free - length
                    left = 0
            else:
                pattern, bins = next(iter(groups[free].items()))
                take = min(free // length, left)
                use = min(bins, left // take)
                if use < bins:
                    groups[free][pattern] = bins - use
                else:
                    del groups[free][pattern]
                    if not groups[free] and free != capacity:
                        del groups[free], space[at]
                done, new, bins = (*pattern, (length, take)), free - take * length, use
                left -= use * take
            if new not in groups:
                groups[new] = {}
                space.insert(bisect_right(space, new), new)
            groups[new][done] = groups[new].get(done, 0) + bins
    return [(p, n) for g in groups.values() for p, n in g.items() if p]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: by the sum, and by items that can't share with what is too large (Martello and Toth)."""
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    items, tokens, half = np.cumsum(n), np.cumsum(n * np.arange(capacity + 1)), capacity // 2
    small = np.arange(half + 1)  # items below this size are left out
    large, mid = items[-1] - items[half], items[capacity - small] - items[half]
    low = tokens[half] - np.where(small > 0, tokens[small - 1], 0)
    room = mid * capacity - (tokens[capacity - small] - tokens[half])
    return int(max(-(-tokens[-1] // capacity), (large + np.maximum(0, -(-(low - room) // capacity))).max()))


def fillings(first: int, counts: dict[int, int], capacity: int, limit: int = MAX_FILLINGS) -> list[Pattern]:
    """Undominated fillings of a bin around its largest item, the fullest first; at most limit are enumerated.

    A filling is dominated if an unused length that fits could be added, or could replace a smaller chosen item.
    """
    lengths = [-k for k in sorted(counts, reverse=True) if counts[k] and k <= first]  # negated: ascending for bisect
    found: dict[Pattern, int] = {}

    def spare(low: int, high: int, chosen: dict[int, int]) -> bool:
        """Whether an unused item has a length in (low, high]."""
        at = bisect_left(lengths, -high)
        while at < len(lengths) and -lengths[at] > low:
            if counts[-lengths[at]] > chosen.get(-lengths[at], 0):
                return True
            at += 1
        return False

    def grown(at: int, room: int, chosen: dict[int, int]) -> Iterator[tuple[int, int, dict[int, int]]]:
        k = -lengths[at]
        for m in range(min(room // k, counts[k] - chosen.get(k, 0)), -1, -1):
            more = dict(chosen)
            if m:
                more[k] = more.get(k, 0) + m
            yield at + 1, room - m * k, more

    # Lengths that are left out make the search deeper than Python's own stack may be.
    levels, steps = [iter([(0, capacity - first, {first: 1})])], 0
    while levels and len(found) < limit and steps < FILLING_STEPS * limit:
        state = next(levels[-1], None)
        if state is None:
            levels.pop()
            continue
        steps += 1
        at, room, chosen = state
        at = max(at, bisect_left(lengths, -room))
        while at < len(lengths) and counts[-lengths[at]] <= chosen.get(-lengths[at], 0):
            at += 1
        if at < len(lengths) and room:
            levels.append(grown(at, room, chosen))
            continue
        others = [c for c, n in chosen.items() if c != first or n > 1]
        if not spare(0, room, chosen) and not any(spare(c, c + room, chosen) for c in others):
            found[tuple(sorted(chosen.items(), reverse=True))] = room
    return sorted(found, key=lambda p: (found[p], [-k for k, n in p for _ in range(n)]))


def fullest(first: int, counts: dict[int, int], capacity: int) -> Pattern:
    """The filling around a largest item that leaves the least room, of several the one with the largest items.

    Bit x of reach[i] says whether items of lengths[i:] can have the sum x; no filling is left out.
    """
    room = capacity - first
    lengths = sorted((k for k, n in counts.items() if n > (k == first) and k <= room), reverse=True)
    reach, mask = [1], (1 << room + 1) - 1
    for k in reversed(lengths):
        sums, left, step = reach[-1], min(counts[k] - (k == first), room // k), 1
        while left:
            take = min(step, left)
            sums |= (sums << k * take) & mask
            left, step = left - take, 2 * step
        reach.append(sums)
    reach.reverse()
    goal, chosen = reach[0].bit_length() - 1, {first: 1}
    for i, k in enumerate(lengths):
        m = next(m for m in range(min(counts[k] - (k == first), goal // k), -1, -1) if reach[i + 1] >> goal - m * k & 1)
        if m:
            chosen[k] = chosen.get(k, 0) + m
            goal -= m * k
    return tuple(sorted(chosen.items(), reverse=True))


def dive(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """A packing of all of counts that fills one bin after the other as far as can be, from the largest length down."""
    rest, done = dict(counts), []
    while rest:
        pattern = fullest(max(rest), rest, capacity)
        uses = min(rest[k] // n for k, n in pattern)
        for k, n in pattern:
            rest[k] -= n * uses
            if not rest[k]:
                del rest[k]
        done.append((pattern, uses))
    return done


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = MAX_NODES) -> list[tuple[Pattern, int]]:
    """Patterns with multiplicities that pack all of counts (length -> items) in as few bins as the search finds.

    Best-fit decreasing is the incumbent. If it meets the lower bound it is optimal; else the dive is tried, and if that
    misses the bound too, branches are explored depth first, keeping every better solution. The first descent always
    reaches a whole packing: max_nodes come on top of the branches that the histogram's lengths need.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return []
    max_nodes += len(counts)  # each branch uses up a length at least
    incumbent = best_fit(counts, capacity)
    best = [sum(n for _, n in incumbent), incumbent]
    bound = lower_bound(counts, capacity)
    if best[0] > bound:
        full = dive(counts, capacity)
        if (n := sum(x for _, x in full)) < best[0]:
            best = [n, full]
    total = sum(k * n for k, n in counts.items())
    rest, done, bins, waste, nodes = dict(counts), [], 0, 0, 0

    def undo() -> None:
        nonlocal bins, waste
        pattern, uses = done.pop()
        for k, n in pattern:
            rest[k] = rest.get(k, 0) + n * uses
        bins -= uses
        waste -= uses * (capacity - sum(k * n for k, n in pattern))

    # One filling at a time is applied to the remaining counts and taken back, so memory doesn't grow with the search.
    levels = [iter(fillings(max(rest), rest, capacity))]
    while levels and best[0] > bound and nodes < max_nodes:
        pattern = next(levels[-1], None)
        if pattern is None:
            levels.pop()
            if done:
                undo()
            continue
        nodes += 1
        uses = min(rest[k] // n for k, n in pattern)
        for k, n in pattern:
            rest[k] -= n * uses
            if not rest[k]:
                del rest[k]
        done.append((pattern, uses))
        bins += uses
        waste += uses * (capacity - sum(k * n for k, n in pattern))
        if not rest:
            if bins < best[0]:
                best = [bins, list(done)]
            undo()
        elif waste > (best[0] - 1) * capacity - total:
            # A better solution has at most best - 1 bins, so it can't waste more than this.
            undo()
        else:
            if nodes % 8 == 1:
                tail = dive(rest, capacity) if len(rest) <= SMALL or nodes % 1024 == 1 else best_fit(rest, capacity)
                if bins + (n := sum(x for _, x in tail)) < best[0]:
                    best = [bins + n, [*done, *tail]]
            levels.append(iter(fillings(max(rest), rest, capacity)))
    return best[1]


# -- places -----------------------------------------------------------------------------------------------------------


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset of the first item, items in a bin), by first rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, bins in patterns:
        at = 0
        for k, n in pattern:
            out.setdefault(k, []).append((used.get(k, 0), sequence, at, n))
            used[k] = used.get(k, 0) + n * bins
            at += k * n
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kept_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, sequences, lower_bound: a row for each piece of each row of docs.

    sequences is how many the packing takes, lower_bound how many any packing needs; where they are equal the packing is
    best. A null text counts as empty: its end id alone is packed. Repeated rows are packed each; a null id stays null.
    Only texts of more than capacity tokens are cut. Ids and counts of lengths are exact; other columns are not read, so
    their names may clash. An empty table gives an empty result. kept_words bounds a worker's memory, about 200 bytes a
    word; results don't depend on it.
    """
    own = pieces(docs, tokenizer_path, capacity, id_col, text_col, kept_words)
    # At most capacity rows, whatever the input: they come to the driver and go to every task.
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    patterns = bin_completion(counts, capacity)
    plan, sequences, bound = places(patterns), sum(n for _, n in patterns), lower_bound(counts, capacity) if counts else 0
    parts = docs.sparkSession.createDataFrame([(k, -(-n // PART_ROWS)) for k, n in counts.items()], "length long, parts long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k in np.unique(length):
                at = np.flatnonzero(length == k)
                r, rows = rank[at], plan[k]
                x = rows[np.searchsorted(rows[:, 0], r, "right") - 1]
                sequence[at] = x[:, 1] + (r - x[:, 0]) // x[:, 3]
                offset[at] = x[:, 2] + (r - x[:, 0]) % x[:, 3] * k
            whole = (pa.array(np.full(b.num_rows, n, np.int64)) for n in (sequences, bound))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(sequence), pa.array(offset), *whole], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "sequences", "lower_bound"])

    dealt = own.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("row", "piece"), F.col("parts")))
    # The ranks before a part's first: a row for each length and each PART_ROWS pieces.
    groups = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "part").orderBy("row", "piece"))).join(groups, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, sequences long, lower_bound long")
