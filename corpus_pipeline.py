"""The corpus pipeline: five stages from raw documents to token ids.

STAGES lists (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of documents.  :func:`run` writes each stage's result to the shared folder and reads it back, so
lineage is cut between stages and a lost executor costs one stage at most.  What a stage stages itself is freed when its
result is written, and so is the result before it.

Odd input: documents with a null or empty text stay and are encoded as nothing; texts of which the third stage leaves
nothing go; of rows with the same id and text one stays; rows with a null id are judged like others; very long texts are
handled whole; an empty table gives an empty result; further columns come through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberflow.llm import bpe, decontam, neardup, suffixes, toxicity
from emberflow.llm.shared import drop_staged, scratch, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on labels of these documents, doesn't judge toxic."""
    return toxicity.harmless(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, width=5, threshold=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of over 50 words whose strings of 240 bytes all start elsewhere, too.

    The shorter length than that of op8 is chosen for passages of just over 50 words, of which 99 in 100 take 254 bytes
    or more; short repeated lines stay, as do repeats without words.
    """
    return suffixes.without_repeats(docs, length=suffixes.PASSAGE_LENGTH, gram=suffixes.PASSAGE_GRAM, words=suffixes.PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, and the text that decoding them gives."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can't express these stages; tests/llm/test_other_operators.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        with scratch() as held:
            out = function(spark, docs, sf_dir)
        before, docs = docs, stage(out, f"pipeline-{name}", codec="snappy")
        drop_staged(*held, before)
    return docs
