"""The registered query of each operator, with its parameters, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import table

#: Files of public tokenizers, looked up by name.
PIECE_MODEL = "piece_bpe_32k.model"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 4,096."""
    from auditlake.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_MODEL), limit=4096)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by three words at 85 percent."""
    from auditlake.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and tags of every document."""
    from auditlake.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores by a model of the labels that aren't held out."""
    from auditlake.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for each vector whose id is divisible by 50."""
    from auditlake.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5, scale=256)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of at most 4,096 tokens."""
    from auditlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), capacity=4096)


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document."""
    from auditlake.llm.maxent_lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from auditlake.llm.secrets import secret_scan

    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix of sources takes each document."""
    from auditlake.llm.entropy_mix import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal but for white space."""
    from auditlake.llm.quotient_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of nearly equal bytes, groups of equal texts together."""
    from auditlake.llm.sharding import shard_rows

    return shard_rows(table(spark, sf_dir, "documents"), shards=24)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof; of documents whose id's CRC-32 is divisible by 7, n_chars is altered before the fold."""
    from auditlake.llm.merkle import verified_rows

    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    return verified_rows(table(spark, sf_dir, "documents"), {"n_chars": F.col("n_chars") + 1}, altered)


def op13_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector in its first 32 whitened components."""
    from auditlake.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), most=32)


OP10_SQL = r"""
WITH own AS (
  SELECT doc_id, sha256(norm) AS text_sha256, norm
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM own WINDOW g AS (PARTITION BY norm)
"""

OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words
), single AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM single x JOIN single y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
)
SELECT sets.doc_id, len(s) AS n_shingles, c.component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = sets.doc_id
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), one AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
scored AS (
  SELECT q.vec_id AS query_id, o.vec_id AS vec_id, CAST(sum(q.x * o.x) AS BIGINT) AS score
  FROM one q JOIN one o ON q.i = o.i AND q.vec_id <> o.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

CRC_SQL = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""


def crc_of(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL expression, where crc_table is joined."""
    code = f"list_transform(string_split({text}, ''), lambda s: CAST(unicode(s) AS BIGINT))"
    bytes_ = f"""flatten(list_transform({code}, lambda u: CASE WHEN u < 0 THEN CAST([] AS BIGINT[]) WHEN u < 128 THEN [u] WHEN u < 2048 THEN [192 + (u >> 6), 128 + (u & 63)]
      WHEN u < 65536 THEN [224 + (u >> 12), 128 + ((u >> 6) & 63), 128 + (u & 63)] ELSE [240 + (u >> 18), 128 + ((u >> 12) & 63), 128 + ((u >> 6) & 63), 128 + (u & 63)] END))"""
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bytes_}), lambda c, b: xor(t[CAST(xor(c, b) & 255 AS INTEGER) + 1], c >> 8)), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {CRC_SQL}, d AS (
  SELECT doc_id, strlen(text) + 8 AS size, {crc_of("text")} AS text_crc32, CAST('0x' || substr(sha256(text), 1, 15) AS BIGINT) AS key
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), crc_table
), g AS (SELECT key, CAST(sum(size) AS BIGINT) AS size, CAST(sum(sum(size)) OVER () AS BIGINT) AS total FROM d GROUP BY key),
ordered AS (SELECT *, row_number() OVER w AS r, total - sum(size) OVER w + size AS rest FROM g WINDOW w AS (ORDER BY size DESC, key)),
alone AS (SELECT key, r - 1 AS shard FROM ordered WHERE r < 24 AND size * 16384 > total AND size * (25 - r) >= rest),
line AS (SELECT key, size, CAST(sum(size) OVER (ORDER BY size * 16384 <= total, key) AS BIGINT) AS e FROM g WHERE key NOT IN (SELECT key FROM alone)),
facts AS (SELECT 24 - (SELECT count(*) FROM alone) AS k, max(e) AS whole FROM line),
pos AS (SELECT 0 AS e UNION ALL SELECT e FROM line),
best AS (
  SELECT 1 AS j, e, e AS f FROM pos
  UNION ALL
  SELECT b.j + 1, p.e, min(greatest(b.f, p.e - b.e)) FROM best b JOIN pos p ON p.e >= b.e, facts WHERE b.j < k GROUP BY b.j, p.e
), cap AS (SELECT f AS c FROM best, facts WHERE j = k AND e = whole),
lowest AS (
  SELECT k AS j, whole AS e FROM facts
  UNION ALL
  SELECT l.j - 1, min(p.e) FROM lowest l JOIN cap ON true JOIN pos p ON p.e >= l.e - c WHERE l.j > 1 GROUP BY l.j
), aims AS (SELECT CAST(j AS BIGINT) AS j, j * whole // k AS aim FROM facts, range(1, 24) r(j) WHERE j < k),
near AS (
  SELECT j, CASE WHEN aim - max(p.e) FILTER (WHERE p.e <= aim) <= min(p.e) FILTER (WHERE p.e >= aim) - aim THEN max(p.e) FILTER (WHERE p.e <= aim) ELSE min(p.e) FILTER (WHERE p.e >= aim) END AS e
  FROM aims, pos p GROUP BY j, aim
), cuts AS (
  SELECT CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS e
  UNION ALL
  SELECT q.j + 1, least(greatest(n.e, l.e, q.e), max(p.e)) FROM cuts q JOIN near n ON n.j = q.j + 1 JOIN lowest l ON l.j = q.j + 1 JOIN cap ON true JOIN pos p ON p.e <= q.e + c GROUP BY q.j, q.e, n.e, l.e
), placed AS (
  SELECT key, shard FROM alone
  UNION ALL
  SELECT key, 24 - k + (SELECT count(*) FROM cuts WHERE j > 0 AND cuts.e <= line.e - line.size) FROM line, facts
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN placed USING (key)
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL}, named AS (
  SELECT doc_id, lang, {crc_of("coalesce(CAST(doc_id AS VARCHAR), '')")} % 7 = 0 AND doc_id IS NOT NULL AS tampered, n_chars,
    [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text] AS own, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars + 1 AS VARCHAR), text] AS other
  FROM documents, crc_table
), hashed AS (
  SELECT doc_id, lang, sha256(list_aggregate([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN own], 'string_agg', '')) AS leaf,
    CASE WHEN tampered THEN sha256(list_aggregate([CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN other], 'string_agg', '')) END AS changed
  FROM named
), leaves AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, i, leaf AS node FROM leaves
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, i // 2
), subroots AS (SELECT tree, max(level) AS depth, arg_max(node, level) AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes GROUP BY tree),
tops AS (
  SELECT 0 AS level, place AS i, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(node, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, i // 2
), height AS (SELECT max(level) AS height, arg_max(node, level) AS root FROM tops),
fold AS (
  SELECT tree, i AS leaf_i, depth, place, 0 AS level, i, coalesce(changed, leaf) AS own, '' AS proof FROM leaves JOIN subroots USING (tree)
  UNION ALL
  SELECT f.tree, f.leaf_i, f.depth, f.place, f.level + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.own || coalesce(n.node, '') ELSE n.node || f.own END), f.proof || coalesce(n.node, '')
  FROM fold f LEFT JOIN nodes n ON n.tree = f.tree AND n.level = f.level AND n.i = xor(f.i, 1) WHERE f.level < f.depth
), above AS (
  SELECT tree, leaf_i, 0 AS level, place AS i, own, proof FROM fold WHERE level = depth
  UNION ALL
  SELECT f.tree, f.leaf_i, f.level + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 0 THEN f.own || coalesce(n.node, '') ELSE n.node || f.own END), f.proof || coalesce(n.node, '')
  FROM above f JOIN height ON true LEFT JOIN tops n ON n.level = f.level AND n.i = xor(f.i, 1) WHERE f.level < height
)
SELECT l.doc_id, l.leaf, s.subroot, root, sha256(a.proof) AS proof_sha256, a.own AS folded_root, a.own = root AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN height ON true JOIN above a ON a.tree = l.tree AND a.leaf_i = l.i AND a.level = height
"""


def op8_sql() -> str:
    """The scan of every rule over every text; places from the lengths of matches and of the text between them."""
    from auditlake.llm.secrets import BASE_RULES, MORE_RULES

    one = []
    for number, r in enumerate(BASE_RULES + MORE_RULES):
        pattern = "'" + r.pattern.replace("'", "''") + "'"
        one.append(f"""
          SELECT doc_id, {number} AS number, '{r.kind}' AS kind, i, m, g, len(p[i]) >= {r.least} AS fits
          FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), {pattern}, 0) AS m, regexp_split_to_array(coalesce(text, ''), {pattern}) AS g,
                   regexp_extract_all(coalesce(text, ''), {pattern}, {r.group}) AS p FROM documents))""")
    counts = ", ".join(f"count(*) FILTER (WHERE number = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""
    WITH hit AS ({" UNION ALL ".join(one)}), placed AS (
      SELECT doc_id, number, kind, list_sum([len(x) FOR x IN g[1:i]]) + coalesce(list_sum([len(x) FOR x IN m[1:i - 1]]), 0) AS a, len(m[i]) AS n FROM hit WHERE fits
    ), found AS (SELECT doc_id, number, a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT) AS span FROM placed),
    per AS (
      SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY a, number) AS spans, string_agg(span, ',' ORDER BY a, number) FILTER (WHERE number < {len(BASE_RULES)}) AS base
      FROM found GROUP BY doc_id
    )
    SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM documents d LEFT JOIN per USING (doc_id)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_secret_scan": op8_secret_scan,
    "op9_source_mix": op9_source_mix,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_minimax_shards": op11_minimax_shards,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_jacobi_whitening": op13_jacobi_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_dedup": OP2_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op8_secret_scan": op8_sql(),
    "op10_exact_dedup": OP10_SQL,
    "op11_minimax_shards": OP11_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
