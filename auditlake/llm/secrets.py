"""Secret scans with a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query is derived: a conjunction of alternatives, each a literal that a match
must contain. A literal is replaced by its trigrams, all of which must occur. The index holds a posting (trigram, row key)
for each trigram that some rule's query names; evaluating a query intersects the postings of each literal's trigrams and
unites those of alternatives. Only candidates are verified with the regular expression: a bitmap of their keys, sized by
their number, picks them out of the scan, so other texts are never shuffled. A rule without any mandatory trigram scans
every text.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as code
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """kind; pattern; group whose length counts (0: the match) and its least length."""

    kind: str
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds are listed. Fixed values.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Rules that the scan adds. Fixed values.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("basic", r"://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!$-]{6,}@", 0, 1),
    Rule("bearer", r"(?i)bearer +[A-Za-z0-9._~+/-]{20,}=*", 0, 1),
)
#: Strings that a part of a pattern may stand for before it is cut there.
MOST_STRINGS = 64
#: Bits of the bitmap of candidates for each of them, and at most: 4 MB. Beyond that more texts than the candidates are joined.
BITS_EACH, MOST_BITS = 16, 1 << 25

Conjuncts = list[frozenset[str]]


def minimal(strings: set[str]) -> frozenset[str]:
    """The strings without those that contain another: an alternative that is implied says nothing."""
    return frozenset(x for x in strings if not any(y != x and y in x for y in strings))


def derived(pattern: str) -> Conjuncts:
    """What a match must contain, in lower case: from each set one string at least; nothing where the pattern can't be read.

    A part of the pattern that stands for few strings is written out as these; parts in a row are multiplied out until
    something unbounded comes between. Alternatives are written out too, or else each gives its best set.
    """
    try:
        tree = parser.parse(pattern)
    except re.error:
        return []
    strings, found = read(tree)
    return [x for x in [*found, *([] if strings is None else [minimal(strings)])] if min(map(len, x), default=0) >= 3]


def read(tree) -> tuple[set[str] | None, Conjuncts]:
    """The strings that a sequence stands for (None: too many), or else the conjuncts of its parts."""
    now, found, whole = {""}, [], True

    def close() -> None:
        nonlocal now, whole
        found.append(minimal(now))
        now, whole = {""}, False

    for op, value in tree:
        for strings, more, ends in read_one(op, value):
            found += more
            if strings is None:
                close()
            elif len(now) * len(strings) > MOST_STRINGS:
                close()
                now = strings
            else:
                now = {a + b for a, b in product(now, strings)}
            if ends:
                close()
    if whole:
        return now, []
    return None, [*found, minimal(now)]


def read_one(op, value) -> list[tuple[set[str] | None, Conjuncts, bool]]:
    """Parts of one element: strings or None, conjuncts, and whether anything may follow that isn't written out."""
    none = [(None, [], False)]
    if op is code.LITERAL:
        return [({chr(value).lower()}, [], False)]
    if op is code.IN:
        letters: set[str] = set()
        for kind, x in value:
            if kind is code.LITERAL:
                letters.add(chr(x).lower())
            elif kind is code.RANGE and x[1] - x[0] < MOST_STRINGS // 4:
                letters |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return none
        return [(letters, [], False)] if len(letters) <= MOST_STRINGS // 4 else none
    if op in (code.AT, code.ASSERT, code.ASSERT_NOT):
        return [({""}, [], False)]
    if op is code.SUBPATTERN:
        strings, more = read(value[3])
        return [(strings, more, False)]
    if op is code.ATOMIC_GROUP:
        strings, more = read(value)
        return [(strings, more, False)]
    if op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT):
        least, most, inner = value
        strings, more = read(inner)
        if least == 0:
            return [(strings | {""}, [], False)] if strings is not None and most == 1 else none
        if strings is None:
            return [(None, more, False)]
        # As many as must be; what may come on top isn't written out.
        return [(strings, [], False)] * (min(least, 16) - 1) + [(strings, [], most != least or least > 16)]
    if op is code.BRANCH:
        branches = [read(x) for x in value[1]]
        if all(strings is not None for strings, _ in branches) and len(every := set().union(*(strings for strings, _ in branches))) <= MOST_STRINGS:
            return [(every, [], False)]
        best = [max([*more, *([] if strings is None else [minimal(strings)])], key=lambda x: (min(map(len, x), default=0) >= 3, -len(x)), default=frozenset()) for strings, more in branches]
        return [(None, [minimal(set().union(*best))] if all(best) else [], False)]
    return none


def trigrams(literal: str) -> frozenset[str]:
    """The trigrams that a text with the literal must have; none for a shorter literal."""
    return frozenset(literal[i : i + 3] for i in range(len(literal) - 2))


def trigram_query(rule: Rule) -> list[list[frozenset[str]]]:
    """And of ors of sets of trigrams."""
    return [[trigrams(x) for x in sorted(conjunct)] for conjunct in derived(rule.pattern)]


def index_terms(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for conjunct in trigram_query(r) for x in conjunct for t in x})


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: a row's identity is its id and its text, so repeated rows share their postings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    return docs.select(key.alias("doc_id"), text.alias("text")).withColumn("key", F.struct(F.coalesce("doc_id", F.lit(0)).alias("a"), F.xxhash64("text").alias("b"), F.length("text").alias("c")))


def postings(rows: DataFrame, terms: list[str]) -> DataFrame:
    """The inverted index: term (place in terms), key. Case is folded, so an index serves rules of either case."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(terms))))
    return rows.select("key", low.alias("low")).select("key", F.explode(found).alias("term"))


def candidates(index: DataFrame, terms: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules (their places): rows whose postings satisfy a rule's query."""
    at = {t: i for i, t in enumerate(terms)}
    # The lists of a key's terms meet as bits: an intersection is a mask, and partial masks are made before the shuffle.
    words = range(0, len(terms), 62)
    bits = [F.expr(f"bit_or(case when term between {w} and {w + 61} then shiftleft(1L, term - {w}) else 0L end)").alias(f"m{w}") for w in words]
    masks = index.groupBy("key").agg(*bits)

    def has(x: frozenset[str]) -> Column:
        need: dict[int, int] = {}
        for t in x:
            need[at[t] // 62 * 62] = need.get(at[t] // 62 * 62, 0) | 1 << at[t] % 62
        return reduce(operator.and_, (F.col(f"m{w}").bitwiseAND(F.lit(m)) == m for w, m in sorted(need.items())))

    met = [F.when(reduce(operator.and_, (reduce(operator.or_, map(has, c)) for c in trigram_query(r))), F.lit(i)) for i, r in enumerate(rules)]
    return masks.select("key", F.array_compact(F.array(*met)).alias("rules")).where(F.size("rules") > 0)


def picked(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The rows whose key may be in hits, by a bitmap of the hits' keys; none of these is lost.

    The bitmap is one row of at most 4 MB, made of as many words as the number of hits asks for.
    """
    bits = 1 << max(10, (BITS_EACH * hits.count()).bit_length())
    bits = min(bits, MOST_BITS)
    place = F.xxhash64("key").bitwiseAND(F.lit(bits - 1))
    words = hits.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(xxhash64(key) & 63 as int))").alias("bit")).groupBy("word").agg(F.expr("bit_or(bit)").alias("bit"))
    every = hits.sparkSession.range(bits >> 6).select(F.col("id").alias("word")).join(words, "word", "left").select("word", F.coalesce("bit", F.lit(0)).alias("bit"))
    bitmap = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bit"))), lambda x: x["bit"]).alias("bitmap"))
    inside = F.expr("element_at(bitmap, cast(shiftright(place, 6) as int) + 1) & shiftleft(1L, cast(place & 63 as int)) != 0")
    return rows.withColumn("place", place).crossJoin(F.broadcast(bitmap)).where(inside).drop("place", "bitmap")  # one row


def running(lengths: Column) -> Column:
    """Sums of an array up to each of its places: each pass adds what stands 1, 2, 4, ... places before."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(lengths))).cast("int"), F.lit(0)))

    def add(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))

    return F.aggregate(passes, lengths, add)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """Array of (start, number, end) of a rule's matches, leftmost and non-overlapping, in code points.

    The text between matches and the matches themselves give the places: their lengths add up. The work is that of the
    expression and of log n passes over its n matches.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.split(text, rule.pattern, -1)
    parts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # The split's last piece follows the last match: zip_with leaves a row without a match, which is cut off.
    joined = F.zip_with(F.zip_with(found, gaps, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), parts, lambda x, p: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.length(p).alias("p")))

    def placed(each: Column) -> Column:
        ends = running(F.transform(each, lambda x: x["m"] + x["g"]))
        own = F.zip_with(each, ends, lambda x, e: F.struct((e - x["m"]).alias("start"), F.lit(number).alias("number"), e.alias("end"), x["p"].alias("p")))
        return F.transform(F.filter(own, lambda x: x["p"] >= rule.least), lambda x: F.struct(x["start"].alias("start"), x["number"].alias("number"), x["end"].alias("end")))

    # An array of one binds what was found to a name, so that the expression is evaluated once.
    whole = F.filter(joined, lambda x: x["m"].isNotNull())
    return F.element_at(F.transform(F.array(whole), placed), 1).cast("array<struct<start:int,number:int,end:int>>")


def secret_scan(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of each base rule, base_sha256, spans, found (array of start, number, end), one row for each row of docs.

    spans: kind:start:end of all matches by start, then in the order of the rules, comma-joined; places count code
    points, end exclusive. base_sha256: SHA-256 of the same list of the base rules' matches alone. A null text counts
    as empty and has no match; the hash is then that of the empty string. Repeated rows give repeated results; a null
    id stays null; other columns are not read. An empty table gives an empty result.
    """
    rules = BASE_RULES + more
    indexed = tuple(r for r in rules if trigram_query(r))
    full = tuple(r for r in rules if not trigram_query(r))
    terms = index_terms(indexed)
    rows = keyed(docs, id_col, text_col)
    hits = cut(candidates(postings(rows, terms), terms, indexed), "candidates")
    empty = F.array().cast("array<struct<start:int,number:int,end:int>>")
    # A candidate's text meets its rules; the others need no regular expression. Verified spans are small.
    verify = [F.when(F.array_contains("rules", i), spans(F.col("text"), r, rules.index(r))).otherwise(empty) for i, r in enumerate(indexed)]
    verified = picked(rows, hits).join(hits, "key").select("key", F.concat(*verify).alias("verified")).where(F.size("verified") > 0).dropDuplicates(["key"])
    verified = cut(verified, "verified")
    scanned = rows.select("doc_id", "key", F.concat(*(spans(F.col("text"), r, rules.index(r)) for r in full)).alias("scanned"))
    both = scanned.join(verified, "key", "left").select("doc_id", F.array_sort(F.concat("scanned", F.coalesce("verified", empty))).alias("found"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    n_base = len(BASE_RULES)

    def listed(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda s: s["number"] == number)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return both.select("doc_id", *counts, F.sha2(listed(F.filter("found", lambda s: s["number"] < n_base)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found")
