"""Token counts by a finite-state transducer compiled from the pieces of a sentencepiece model.

The transducer reads characters and emits numbers of tokens. By the merges of the model, the tokens of a prefix of a text
are those of a shorter prefix and one last token, and this last token is the only piece that ends there and stands beside
the token before it unmerged. So what may follow depends on few places: a state is the longest end of what was read that
begins a longer piece, and for each place in it from which a piece may yet go on, how many tokens fewer the text had there
and what its last token was. Equal states are one; a transition carries the change in the number of tokens. States and
transitions are compiled when first met, from the pieces alone; the model's library only gives the pieces.

No piece has a word mark (U+2581) or a newline after another character, so the transducer is back in its start state before
a run of spaces or a newline. A text is cut into chunks at any character. The map of a chunk, from the state before it to
the state after it and the tokens emitted, is (head, count, tail): the characters before its first boundary, the tokens of
the whole segments after that, the characters after its last boundary. These maps compose associatively, and a text's
count is the last value of a prefix scan (a balanced tree of compositions) over its chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import claim, keeps, slices

#: Characters of a chunk.
CHUNK_CHARS = 1 << 16
#: Segments whose path a worker remembers, states and pairs of pieces; beyond that it begins anew, so memory stays bounded.
MAX_EDGES, MAX_STATES, MAX_PAIRS = 700_000, 250_000, 400_000
#: Longer segments are run when met and not remembered.
MAX_SEGMENT = 48

SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*|[^ \n]+")
BOUNDARY = re.compile(r" +|\n")


class PieceTransducer:
    """States and transitions with emitted token counts, from a table of pieces and their scores (the greater merges first)."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.beginnings = {p[:i] for p in scores for i in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.begin()

    def begin(self) -> None:
        #: Of each state: its characters, and (characters since, tokens fewer, last token) of each place, the first places first.
        self.states: list[tuple[str, tuple[tuple[int, int, str], ...]]] = []
        self.known: dict[tuple, int] = {}
        self.moves: list[dict[str, tuple[int, int]]] = []
        self.state(("", ((0, 0, ""),)))

    def state(self, key: tuple[str, tuple[tuple[int, int, str], ...]]) -> int:
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        return found

    def merged(self, text: str) -> list[str]:
        """The tokens of a short text by its merges: the best pair first, of equal ones the leftmost."""
        score, parts = self.scores.get, list(text)
        scores = [score(a + b) for a, b in pairwise(parts)]
        while True:
            best, at = None, -1
            for i, x in enumerate(scores):
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1])

    def beside(self, a: str, b: str) -> bool:
        """Whether two tokens stay as they are beside each other; of no token and one, whether its characters merge to it."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = (not a or a + b not in self.scores) and self.merged(a + b) == ([a, b] if a else [b])
        return found

    def compile(self, at: int, c: str) -> tuple[int, int]:
        """The transition of a state on a character: the next state and the change in the number of tokens."""
        if c not in self.scores:
            # It merges with nothing: its bytes are its tokens, and what follows starts anew.
            move = 0, len(c.encode(errors="surrogatepass"))
        else:
            before, places = self.states[at]
            text = before + c
            n = len(before)
            token, change = next((text[n - k :], fewer + 1) for k, fewer, last in places if text[n - k :] in self.scores and self.beside(last, text[n - k :]))
            open_places = [(k + 1, fewer - change, last) for k, fewer, last in places if text[n - k :] in self.beginnings]
            kept = text[n + 1 - open_places[0][0] :] if open_places else ""
            move = self.state((kept, (*open_places, (0, 0, token)))), change
        self.moves[at][c] = move
        return move

    def run(self, text: str) -> int:
        """The tokens that reading a text from the start state emits."""
        if len(self.states) > MAX_STATES:
            self.begin()
        at, n = 0, 0
        for c in text:
            found = self.moves[at].get(c)
            at, change = self.compile(at, c) if found is None else found
            n += change
        return n


class CountTransducer:
    """Counts the tokens of texts as the model's library does, without begin or end tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any("▁" in p.lstrip("▁") or "\n" in p for p in scores):
            raise ValueError("a piece crosses a segment boundary; this model can't be compiled by segments")
        self.machine = PieceTransducer(scores)
        self.edges: dict[str, int] = {}

    def compile(self, words: list[str]) -> list[int]:
        """Emitted tokens along the path of each word: a segment without its first space, or one with its newline."""
        run = self.machine.run
        return [run(w if w[:1] == "\n" else "▁" + w.replace(" ", "▁")) for w in words]

    def emitted(self, words: list[str]) -> int:
        """Tokens along a path of edges; those met for the first time are run together."""
        found = list(map(self.edges.get, words))
        if None not in found:
            return sum(found)
        missing = list({w for w, n in zip(words, found, strict=True) if n is None})
        counts = dict(zip(missing, self.compile(missing), strict=True))
        if len(self.edges) + len(counts) > MAX_EDGES:
            self.edges.clear()
        self.edges.update((w, n) for w, n in counts.items() if len(w) <= MAX_SEGMENT)
        return sum(counts[w] if n is None else n for w, n in zip(words, found, strict=True))

    def count_segments(self, text: str) -> int:
        return self.emitted([s[1:] if s[0] == " " else s for s in SEGMENT.findall(text)])

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """(head, count, tail); count is None if no boundary lies inside, and then tail is empty."""
        first = BOUNDARY.search(chunk)
        if first is None:
            return chunk, None, ""
        # A run of spaces that touches an end of the chunk may go on outside it.
        head, body = chunk[: first.start()], chunk[first.start() :]
        last = max(body.rfind(" "), body.rfind("\n"))
        if body[last] == " ":
            while last and body[last - 1] == " ":
                last -= 1
        tail = body[last:]
        if first.start() == 0 and chunk[0] == " ":
            # The leading run of spaces may belong to a run that began before.
            cut = SEGMENT.match(body).end()
            if cut > last:
                return chunk, None, ""
            return body[:cut], self.count_segments(body[cut:last]), tail
        return head, self.count_segments(body[:last]), tail

    def compose(self, a: tuple[str, int | None, str], b: tuple[str, int | None, str]) -> tuple[str, int | None, str]:
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None, ""
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count_segments(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple[str, int | None, str]]) -> tuple[str, int | None, str]:
        """The composition of all maps by a balanced tree."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK_CHARS) -> int:
        if not text:
            return 0
        text = " " + text.replace("▁", " ")
        # A text's own start is a known state, so what lies before the first boundary is a whole segment.
        head, n, tail = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        return sum(self.count_segments(x) for x in (head, tail) if x) + (n or 0)


@lru_cache(maxsize=2)
def transducer(model_path: str) -> CountTransducer:
    """One for each worker process, so that compiled edges serve many tasks."""
    return CountTransducer(model_path)


keeps("token_counts", transducer.cache_clear)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), one row for each row of docs.

    model_path: a sentencepiece model whose merges don't cross words; it has to exist on every executor.
    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results; a null id stays null. Texts
    of any length are read whole. Other columns are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_counts")
        count = transducer(model_path).count
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            tokens = [count(t) if t else 0 for t in texts]
            size = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
