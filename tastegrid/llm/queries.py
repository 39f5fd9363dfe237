"""Registered text queries: thin digests of the operators over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.llm import (
    alignment, bpe, collocations, hosts, language, language_model, lattice, neighbours, positional, shards, simhash, token_counts, token_files,
)
from tastegrid.llm.common import table
from tastegrid.operators.staging import stage_root

SHARDS = 40
# The url rules of the contract, as (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_elias_fano(spark: SparkSession, folder: str) -> DataFrame:
    files = f"{stage_root(spark)}/token-files-{uuid4().hex}"
    token_files.write(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), files)
    return token_files.read(spark, files)


def op2_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count(table(spark, folder, "documents"), public_tokenizers.path(PIECE_BPE))


def op3_positional(spark: SparkSession, folder: str) -> DataFrame:
    return positional.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


def op5_bigru(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


def op6_host_trust(spark: SparkSession, folder: str) -> DataFrame:
    judged = hosts.verdicts(table(spark, folder, "pages"), URL_RULES)
    return judged.withColumns({c: F.round(c, 5) for c in ("trust", "distrust")})


def op7_rendezvous(spark: SparkSession, folder: str) -> DataFrame:
    return shards.assign(table(spark, folder, "documents"), "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op8_e8(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"))


def op9_gru_lm(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.scores(table(spark, folder, "documents"), language.remainder(F.col("doc_id"), 5) == 1)


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op11_stripes(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.mine(table(spark, folder, "documents"))


def op12_multiprobe(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_identity(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.measure(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_elias_fano, op2_overlap, op3_positional, op4_automaton, op5_bigru, op6_host_trust, op7_rendezvous, op8_e8, op9_gru_lm,
        op10_simhash, op11_stripes, op12_multiprobe, op13_identity,
    )
}
