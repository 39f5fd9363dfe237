"""Corpus preparation: keep documents of a known language, one of each near-duplicate group and none with benchmark
passages, then encode them and check the round trip."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tastegrid.llm import bpe, language, positional, simhash
from tastegrid.llm.common import table
from tastegrid.operators.staging import stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of no language that the network knows, go."""
    return language.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, on shingles of five words, the document with the smallest id stays.

    Seven of 64 bits: wider than for exact work on fingerprints, as near copies lie that far apart, and still far below
    the distance of unrelated texts, about 32.
    """
    return simhash.one_per_group(docs, words_per_shingle=5, distance=7, segments=None, ring=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return positional.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe_ids", bpe_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
