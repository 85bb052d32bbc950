"""Corpus pipeline: five operators in a row, each over all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import mixing, ordinal_quality, packing, simhash_dedup, suffix_dedup
from pagewright.llm.common import materialize, release, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the good grade is at least one half; the model is fitted on rated ones.

    Null texts are empty and scored as such; repeated rows are judged alike; without ratings all weights are 0. No documents give none. Texts of any length are scored whole.
    """
    model = ordinal_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal_quality.score(docs, model).where("__pw_kept").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id.

    Null and empty texts are one group. Rows that share the smallest doc_id all stay, as do groups without any doc_id. No documents give none; texts of any length have one
    fingerprint, of all their words.
    """
    return simhash_dedup.keep_first(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier one has.

    A null doc_id comes last; null texts stay as they are; rows that repeat both doc_id and text are one document. No documents give none; texts of any length are compared whole.
    """
    return suffix_dedup.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates of their sources.

    A null source is one of its own, a null text has size 0; a source without words isn't copied, so its documents go. Rows that repeat doc_id, source and text take
    their share together. No documents give none; texts of any length are emitted whole.
    """
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens. A null text is the end id alone; repeated rows are packed as often as they come. No documents give no pieces; texts of any length are cut into pieces of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Fitted weights, tokenizer ids and XXH64 fingerprints are beyond SQL; a plain version of all stages tests run() instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage returns is written as Parquet and read again. Nulls, empty tables, ties and repeated rows are as the stages say."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, keep=before | {docs._pagewright_path})  # what the stages before have written is read
    return STAGES[-1][1](spark, docs, sf_dir)
