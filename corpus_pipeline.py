"""Corpus pipeline over the training-data operators: each stage works on all documents that the one before kept.

Every stage is (spark, docs, sf_dir) -> DataFrame with the columns of ``documents``; the
last one adds the mix's columns.  Between stages the documents are written as Parquet to
the shared scratch folder and read back, so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pocketlens.llm import byte_dedup, decontaminate, mixing, simhash, toxicity
from pocketlens.llm.common import materialise, read_table
from pocketlens.llm.queries import MIX_SEED, MIX_WEIGHTS, TOXIC_THRESHOLD


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"), TOXIC_THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, distance=2, seed=42)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings that stand in several places are cut from the texts; emptied documents go."""
    return byte_dedup.drop_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or paraphrased, go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with their number of copies and the words taken."""
    return mixing.mix_documents(docs, MIX_WEIGHTS, seed=MIX_SEED)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("mix_sources", mix_sources),
]

# The network, the hashes and the knapsack have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
