"""Scans of the driver tables. Schemas come from the Parquet footers; nothing is inferred from values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` by hash of `keys` in three parts a core: a compact file is one task otherwise, however costly what follows is for a row.

    For narrow rows only, since they move.
    """
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
