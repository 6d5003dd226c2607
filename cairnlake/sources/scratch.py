"""Tables in the folder that the driver and all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own.

    A master that isn't local must name the folder: a machine-local one would lose rows there.
    """
    if found := spark.conf.get("spark.checkpoint.dir", ""):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='cairnlake-')}")
    return spark.conf.get("spark.checkpoint.dir")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Where the tables are that a frame reads, for `discard`.
_PATHS: weakref.WeakKeyDictionary[DataFrame, list[str]] = weakref.WeakKeyDictionary()


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it from there, which cuts its lineage.

    Lost executors only cost their running tasks: what later jobs read is a finished table.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = [path]
    return table


def standing_on(view: DataFrame, *tables: DataFrame) -> DataFrame:
    """`view`, which reads `tables`: who discards it, discards them."""
    _PATHS[view] = [path for table in tables for path in _PATHS.pop(table, [])]
    return view


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialise` that no later job reads. Call it only once all that stands on them is written."""
    for table in tables:
        for path in _PATHS.pop(table, []):
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
