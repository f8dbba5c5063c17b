"""License scans: one Aho-Corasick pass over the words of a text finds notice phrases and identifier tags.

A tag (the words spdx license identifier in any punctuation, then a colon or equals sign) is followed by a license
expression, which a shunting-yard parser reads with the operators and, or, with and parentheses. Its value decides which
labels every choice asks for, which only some, and with which exceptions; that enters the labels and the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import slices, text_bytes

#: Phrases (words in lower case) and their labels. Fixed values.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further phrases that the scan knows, and their labels. Fixed values.
MORE_PHRASES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "unlicense": "unlicense", "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit", "all rights reserved": "all-rights-reserved", "boost software license": "bsl", "artistic license": "artistic", "zlib license": "zlib",
}
TAG = "spdx license identifier"
#: Beginnings of identifiers (lower case, words joined by "-") and their labels; the longest fits. Fixed values.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa",
    "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc0": "cc0", "unlicense": "unlicense", "zlib": "zlib", "bsl": "bsl", "artistic": "artistic", "0bsd": "bsd",
}
#: Bytes that stand between words, and lower case of A-Z.
TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
TAG_START = re.compile(rb"(?<![0-9a-z\x80-\xff])spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[\"'\x20\t]*[:=]", re.IGNORECASE)
TOKEN = re.compile(r"[()\r\n]|[A-Za-z0-9][A-Za-z0-9.+-]*")
#: Binding strength of the operators; with binds an exception to the license before it. Fixed values.
STRENGTH = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """A license expression that can't be read."""


def to_postfix(expression: str, start: int = 0) -> list[str]:
    """Shunting-yard: the tokens of an expression in postfix order, from start to the end of its line.

    What follows a complete expression is not read.
    """
    out: list[str] = []
    operators: list[str] = []
    operand_next = True
    for found in TOKEN.finditer(expression, start):
        token = found.group()
        word = token.lower()
        if token in "\r\n":
            break
        if operand_next:
            if word in STRENGTH or token == ")":
                raise ExpressionError(f"an identifier is missing before {token}")
            if token == "(":
                operators.append(token)
            else:
                out.append(token)
                operand_next = False
        elif word in STRENGTH:
            while operators and operators[-1] != "(" and STRENGTH[operators[-1]] >= STRENGTH[word]:
                out.append(operators.pop())
            operators.append(word)
            operand_next = True
        elif token == ")":
            while operators and operators[-1] != "(":
                out.append(operators.pop())
            if not operators:
                break
            operators.pop()
        else:
            break
    if operand_next or "(" in operators:
        raise ExpressionError("the expression isn't complete")
    return out + operators[::-1]


def evaluate(postfix: list[str]) -> list[frozenset[str]]:
    """The alternatives of an expression, each the identifiers that hold together; an exception stays with its license."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix:
        if token == "with":
            exception, base = stack.pop(), stack.pop()
            stack.append([frozenset(f"{x} with {y}" for x in a for y in b) for a in base for b in exception])
        elif token == "and":
            b, a = stack.pop(), stack.pop()
            stack.append([x | y for x in a for y in b])
        elif token == "or":
            b, a = stack.pop(), stack.pop()
            stack.append(a + b)
        else:
            stack.append([frozenset([token.lower()])])
    return list(dict.fromkeys(stack[0]))


def label_of(identifier: str) -> str:
    """The label of an identifier by its longest known beginning; an unknown one is its own label."""
    name = identifier.split(" with ")[0].lower()
    known = [k for k in IDENTIFIERS if name == k or name.startswith((k + "-", k + "+"))]
    return IDENTIFIERS[max(known, key=len)] if known else f"other-{name}"


class Value(NamedTuple):
    """What an expression offers: all labels, those that every alternative asks for, the number of alternatives."""

    labels: set[str]
    required: set[str]
    alternatives: int


def united(a: set[str], b: set[str]) -> set[str]:
    large, small = (a, b) if len(a) >= len(b) else (b, a)
    large |= small
    return large


def value_of(text: str, start: int = 0) -> Value:
    """The value of an expression; of one that can't be read, no labels and no alternatives.

    and asks for the labels of both sides, or for those that both sides ask for; with adds "with-" and the exception's
    name. Alternatives, whose number may double with each operator, are not written out.
    """
    try:
        postfix = to_postfix(text, start)
    except ExpressionError:
        return Value(set(), set(), 0)
    stack: list[tuple[Value, Value]] = []  # the labels of an operand, and its names, which count if it is an exception
    for token in postfix:
        if token not in STRENGTH:
            label, name = label_of(token), f"with-{token.lower()}"
            stack.append((Value({label}, {label}, 1), Value({name}, {name}, 1)))
            continue
        (more, more_names), (own, own_names) = stack.pop(), stack.pop()
        if token == "with":
            more = more_names
        joined = []
        for x, y in ((own, more), (own_names, more_names)):
            n = x.alternatives + y.alternatives if token == "or" else x.alternatives * y.alternatives
            required = x.required & y.required if token == "or" else united(x.required, y.required)
            joined.append(Value(united(x.labels, y.labels) if x.labels is not y.labels else set(x.labels), required, n))
        stack.append((joined[0], joined[1]))
    return stack[0][0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in (MORE_PHRASES | BASE_PHRASES).items():
        a.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE_PHRASES))
    a.add_word(f" {TAG} ", (len(TAG) + 1, None, False))
    a.make_automaton()
    return a


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, required_labels of a text."""
    words = text.translate(TABLE).split()
    # One character for each byte, so that places in the joined words are places in the text's words.
    joined = f" {b' '.join(words).decode('latin-1')} "
    base, more, places, tagged = set(), set(), [], False
    n_base = n_more = 0
    for end, (length, label, is_base) in automaton().iter(joined):
        if label is None:
            tagged = True
        elif is_base:
            base.add(label)
            n_base += 1
            places.append(end - length)
        else:
            more.add(label)
            n_more += 1
    n_sure = n_choices = 0
    required: set[str] = set()
    if tagged:
        line = text.decode("latin-1")  # tokens are ASCII, and places stay those of the bytes
        for m in TAG_START.finditer(text):
            value = value_of(line, m.end())
            more |= value.labels
            required |= value.required
            n_sure += bool(value.required)
            n_choices += bool(value.labels) and not value.required
    first = joined.count(" ", 0, min(places)) if places else None
    last = joined.count(" ", 0, max(places)) if places else None
    # A tag that asks for some license is nearly certain, one that leaves a choice less so; a phrase is strong evidence; several agree.
    score = 1 - 0.05**n_sure * 0.1**n_choices * 0.25 ** min(n_base, 8) * 0.4 ** min(n_more, 8)
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), round(score, 9), ",".join(sorted(required))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, required_labels, one row for each row of docs.

    Words are runs of ASCII letters, digits and non-ASCII characters. n_base counts every place of a base phrase;
    first_word and last_word are its smallest and largest start, null without any. A null text counts as empty: no
    words, no labels, score 0. Every tag counts, and its expression is read to its end or the end of its line, however
    long; one that can't be read adds no label. required_labels are those that every alternative of some expression asks
    for. Repeated rows give repeated results; a null id stays null; other columns are not read. An empty table gives an
    empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
        for b in slices(batches):
            rows = [scan(t) for t in text_bytes(b.column(1))]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "required_labels"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, required_labels string")
