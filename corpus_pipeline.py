"""The corpus pipeline: documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditlake.llm.common import cut, table
from auditlake.llm.entropy_mix import mixed_documents
from auditlake.llm.near_dedup import without_near_duplicates
from auditlake.llm.packing import pack
from auditlake.llm.queries import WORD_TOKENIZER, tokenizer_path
from auditlake.llm.quotient_dedup import without_duplicates
from auditlake.llm.toxicity import fit, without_toxic

#: A document at or above this score goes.
TOXIC = 0.3
#: Words of a shingle and percent of similarity at which documents count as near duplicates.
SHINGLE_WORDS, SIMILAR = 5, 80
SEQUENCE_TOKENS = 4096
#: Words whose ids a packing worker keeps: few, beside what the stages before have left of an executor's memory.
KEPT_WORDS = 250_000


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below TOXIC, by a model of the labels of sf_dir that aren't held out; null and empty texts stay."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")), TOXIC)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for runs of white space, that with the smallest id; null counts as empty."""
    return without_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity SIMILAR join, that with the smallest id; texts without words stay."""
    return without_near_duplicates(docs, SHINGLE_WORDS, SIMILAR)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, up to twice; texts without words stay once."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each copy, with its place in a sequence of SEQUENCE_TOKENS; an empty text is its end token."""
    return pack(docs, tokenizer_path(WORD_TOKENIZER), SEQUENCE_TOKENS, kept_words=KEPT_WORDS)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]
#: Tokenizers, fitted models and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: one for each piece of each document of the mix; none of an empty table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
