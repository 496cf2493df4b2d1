"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, decontam, licences, neardup, negatives, packed, passages, prefix_trie, sharding, suffixes, toxicity, urls

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.read_report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removal_report(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"), relabel=negatives.contract_label())


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents")).drop("row_key")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), period=prefix_trie.PERIOD).drop("level", "n_ends")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe, op2_substring_dedup, op3_toxicity, op4_licence_scan, op5_url_filter,
        op6_decontamination, op7_packed_token_ids, op8_suffix_dedup, op9_nearest_neighbours, op10_minhash_near_dedup,
        op11_hard_negatives, op12_sharding, op13_prefix_trie,
    )
}

#: Queries without an entry are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op4_licence_scan": licences.oracle(), "op5_url_filter": urls.ORACLE, "op11_hard_negatives": negatives.ORACLE, "op12_sharding": sharding.oracle(), "op13_prefix_trie": prefix_trie.ORACLE}
