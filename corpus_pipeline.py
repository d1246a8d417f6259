"""Corpus preparation from raw documents to tokens, stage by stage.

Each stage is ``f(spark, docs, sf_dir)``: it gets what the stage before kept, with the columns of
``documents``, and returns what it keeps with the same columns; the last one returns the tokens of every
document that is left. Nulls, empty and very long texts, repeated rows and empty tables are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm import bpe, exact_dedup, mixing, near_copies, quality
from tracelake.llm.common import id_remainder, materialise, table
from tracelake.llm.queries import tokenizer_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects; it learns from labels outside the held-out fold."""
    held_out = id_remainder("doc_id", 5) == 0
    model = quality.fit(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    return quality.keep_good(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return near_copies.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document: counts and digests of the ids and of the decoded text."""
    return bpe.tokenize(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("bpe", tokens),
]

#: SQL cannot express the classifier, the fingerprints or the tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
