import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from auditlake.llm.packing import WordIds, best_fit, bin_completion, dive, fillings, fullest, lower_bound, pack
from auditlake.llm.queries import PIECE_MODEL, WORD_TOKENIZER, tokenizer_path
from auditlake.llm.token_counts import CountTransducer, PieceTransducer, count_tokens


def test_counts_equal_the_library(spark, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    got = Counter(tuple(r) for r in count_tokens(docs, tokenizer_path(PIECE_MODEL), limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    want = Counter((i, len((t or "").encode()), n, n > 100) for i, t, *_ in rows for n in [len(model.encode(t or ""))])
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_transducer_against_merges_one_by_one(seed):
    """Vocabularies of random merges: the states' counts are those of merging whole texts, and few states serve many texts."""
    r = random.Random(seed)
    pieces = list("abcde")
    while len(pieces) < 40:
        new = r.choice(pieces) + r.choice(pieces)
        if new not in pieces and len(new) <= 7:
            pieces.append(new)
    machine = PieceTransducer({p: -float(i) for i, p in enumerate(pieces)})

    def plain(text):
        parts = list(text)
        while pairs := [(pieces.index(x + y), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in pieces]:
            at = min(pairs)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return sum(1 if p in pieces else len(p.encode()) for p in parts)

    for _ in range(1500):
        text = "".join(r.choice("aabbccde\u00e9") for _ in range(r.randrange(25)))
        assert machine.run(text) == plain(text), text
    assert len(machine.states) < 2000


def test_chunk_maps_compose_at_any_cut():
    import sentencepiece

    path = tokenizer_path(PIECE_MODEL)
    model, t, r = sentencepiece.SentencePieceProcessor(model_file=path), CountTransducer(path), random.Random(2)
    for _ in range(300):
        s = "".join(r.choice([" ", " ", "\n", "ab", "the", "é", "▁", "\t", "  ", "<s>", "日"]) for _ in range(r.randrange(40)))
        assert {t.count(s, c) for c in (1, 2, 5, 1000)} == {len(model.encode(s))}, s


def test_empty_table(no_docs):
    assert count_tokens(no_docs, tokenizer_path(PIECE_MODEL)).count() == 0
    assert pack(no_docs, tokenizer_path(WORD_TOKENIZER)).count() == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_is_whole_gapless_and_true(docs, rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER))
    got = pack(docs, tokenizer_path(WORD_TOKENIZER), capacity).collect()
    bins = defaultdict(list)
    for r in got:
        assert 0 < r.length <= capacity
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    lengths = Counter(r.length for r in got)
    assert {(r.sequences, r.lower_bound) for r in got} == {(len(bins), lower_bound(dict(lengths), capacity))}
    assert lower_bound(dict(lengths), capacity) <= len(bins) <= sum(n for _, n in best_fit(dict(lengths), capacity))


def test_bin_completion_against_exact_search():
    def exact(items, capacity):
        best = [len(items)]

        def put(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for j, free in enumerate(bins):
                if free >= items[i] and free not in bins[:j]:
                    put(i + 1, [*bins[:j], free - items[i], *bins[j + 1 :]])
            put(i + 1, [*bins, capacity - items[i]])

        put(0, [])
        return best[0]

    r = random.Random(5)
    for _ in range(60):
        items = sorted((r.randrange(1, 21) for _ in range(r.randrange(1, 9))), reverse=True)
        plan = bin_completion(dict(Counter(items)), 20)
        used = Counter(k for p, n in plan for k, m in p for _ in range(n * m))
        assert used == Counter(items)
        assert all(sum(k * m for k, m in p) <= 20 for p, _ in plan)
        assert sum(n for _, n in plan) == exact(items, 20), items


def test_the_bound_is_met_where_best_fit_misses_it():
    r = random.Random(9)
    counts = dict(Counter(r.randrange(20, 600) for _ in range(600)))
    plan = bin_completion(counts, 1000)
    assert sum(n for _, n in best_fit(counts, 1000)) > lower_bound(counts, 1000) == sum(n for _, n in plan)
    used = Counter()
    for p, n in plan:
        assert sum(k * m for k, m in p) <= 1000
        used.update({k: m * n for k, m in p})
    assert used == counts


def test_the_search_mends_what_best_fit_and_the_dive_leave():
    """Histograms whose bound only the branches meet; every one of them is packed in as few bins as there can be."""
    r, gains = random.Random(31), 0
    for _ in range(60):
        counts = dict(Counter(r.randrange(9, 45) for _ in range(40)))
        first = min(sum(n for _, n in best_fit(counts, 100)), sum(n for _, n in dive(counts, 100)))
        found = sum(n for _, n in bin_completion(counts, 100))
        assert lower_bound(counts, 100) <= found <= first
        gains += found < first
    assert gains


def test_ids_of_every_letter_with_every_mark():
    from tokenizers import Tokenizer

    tokenizer, words = Tokenizer.from_file(tokenizer_path(WORD_TOKENIZER)), WordIds(tokenizer_path(WORD_TOKENIZER))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\u00c4\u0130"
    texts = [x for c in letters for m in (*map(chr, range(0x300, 0x370)), "\u0653", "\u3099") for x in (c + m, f"x{c}{m}Y. Z", f"{c}\u05b0{m}", f"{c}{m}.")]
    want = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert list(words.ids([t.encode() for t in texts])) == want


def test_ids_of_batches_with_marks_white_space_and_special_strings():
    """Any texts in one batch; a special token's string in capitals is none, though its lower case would be one."""
    from tokenizers import Tokenizer

    path, r = tokenizer_path(WORD_TOKENIZER), random.Random(8)
    parts = ["Word", "word", "caf\u00e9", "\u00c4\u00d6", "\u65e5\u672c", "e\u0301", "x\u00a0y", "it's", "'s", "a1", "42", ".", "###", ".###", "'", "<|", "|>", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", " ", "\t", "\n\n", "\x0b", ""]
    texts = ["", " ", "<|ENDOFTEXT|>", *("".join(r.choice(parts) for _ in range(r.randrange(12))) for _ in range(800))]
    want = [np.array(x.ids, "<u4").tobytes() for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    words = WordIds(path, 40)
    for at in (0, 1, 300):
        assert [bytes(x) for x in words.ids([t.encode() for t in texts[at:]])] == want[at:]


def test_words_with_marks_at_their_ends_are_encoded_once_for_all():
    words = WordIds(tokenizer_path(WORD_TOKENIZER))
    stems = [a + b for a in ("ban", "cor", "del") for b in ("ta", "mu", "ro", "sky")]
    list(words.ids([" ".join(w + m for w in stems for m in ("", ".", "###", ".$$", "!?")).encode()]))
    assert set(words.known) - {""} == {*stems, ".", "###", ".$$", "!?"}


def test_parts_of_batches_follow_their_bytes():
    import pyarrow as pa

    from auditlake.llm.common import byte_slices

    batch = pa.RecordBatch.from_arrays([pa.array(["abcd", None, "e" * 30, "", "fghij", "k", "l" * 9])], names=["text"])
    got = [b.column(0).to_pylist() for b in byte_slices(iter([batch, batch.slice(0, 0)]), 0, 10)]
    assert sum(got, []) == batch.column(0).to_pylist() and len(got) > 2 and all(sum(len(t or "") for t in x) < 20 or len(x) <= 3 for x in got)


def test_lengths_dealt_into_parts_keep_their_places(spark, monkeypatch):
    from auditlake.llm import packing

    monkeypatch.setattr(packing, "PART_ROWS", 7)
    got = pack(spark.createDataFrame([(i, "a b c"[: i % 6]) for i in range(200)], "doc_id long, text string").repartition(5), tokenizer_path(WORD_TOKENIZER), 8).collect()
    taken = [(r.sequence_id, x) for r in got for x in range(r.offset, r.offset + r.length)]
    assert len(got) == 200 and len(taken) == len(set(taken)) and max(x for _, x in taken) < 8


def test_fullest_filling_against_all_fillings():
    r = random.Random(4)
    for _ in range(200):
        counts = {k: r.randrange(1, 4) for k in r.sample(range(2, 30), 6)}
        first, sums = max(counts), {0}
        for k, n in counts.items():
            sums = {s + k * m for s in sums for m in range(n + (k != first)) if s + k * m <= 40 - first}
        p = fullest(first, counts, 40)
        assert sum(k * m for k, m in p) == first + max(sums) and all(m <= counts[k] for k, m in p) and dict(p)[first] >= 1


def test_fillings_are_undominated():
    for p in fillings(9, {9: 1, 6: 2, 5: 1, 4: 3, 1: 1}, 20):
        room = 20 - sum(k * n for k, n in p)
        left = {9: 0, 6: 2, 5: 1, 4: 3, 1: 1}
        for k, n in p:
            left[k] -= n - (k == 9)
        assert not any(n > 0 and k <= room for k, n in left.items())
