"""The corpus pipeline: five operators of ``cairnlake.llm`` in a row, each stage written and reread as Parquet.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rejected and contaminated documents leave, one document of each near-duplicate class stays, the mixture repeats or
drops documents to meet the sources' target words, and the last stage adds shard and slot.

An empty table passes every stage; rows with nulls are handled as each operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm.common import discard, materialise
from cairnlake.llm.decontaminate import remove_documents
from cairnlake.llm.mixing import mix
from cairnlake.llm.near_duplicates import keep_one_each
from cairnlake.llm.quality import keep_good
from cairnlake.llm.sharding import shard_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mix(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The forest and the sampled splitters aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the next stages read only what is written now; the given table isn't ours to delete and stays
    return STAGES[-1][1](spark, docs, sf_dir)
