"""A training-data pipeline: toxic, near-duplicate, repeated and benchmark text goes, and sources are mixed to weights.

    run(spark, sf_dir) -> the mixed documents, with the number of copies of each

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs.  Stages handle nulls, empty tables, repeated rows and extra columns as their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwarden.llm import decontaminate, mixing, near_duplicates, suffix_array, toxicity
from driftwarden.session import stage_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from those of `docs` that have a label, scores below the cut."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8 or more), that with the smallest doc_id."""
    return near_duplicates.keep_one(docs, n=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words are kept in the document with the smallest doc_id only."""
    return suffix_array.cut_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with `copies`."""
    return mixing.mix(docs, weights=(1.0, 2.0, 3.0))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeated_passages", cut_repeats),
          ("decontamination", drop_leaks), ("source_mix", mix_sources)]

ORACLE_SQL = None       # the learned lexicon and the rounding have no SQL form; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
