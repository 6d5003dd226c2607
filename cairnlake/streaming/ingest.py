"""Incremental ingest: documents arrive as a stream, passages leave it once, superseded evidence is found per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.passages import passages


def document_stream(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def passage_stream(docs: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Lines of newly seen texts: copies that arrive within the watermark are dropped by their hash."""
    hashed = docs.withColumn("sha256", F.sha2("text", 256)).withWatermark("created_at", delay)
    fresh = hashed.dropDuplicatesWithinWatermark(["sha256"])
    lines = fresh.select("doc_id", "created_at", F.posexplode(F.split("text", "\n")).alias("ordinal", "raw"))
    return lines.select("doc_id", "created_at", "ordinal", F.trim("raw").alias("line")).filter("line <> ''")


def usage_stream(events: DataFrame, *, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling sums per account and kind with late rows up to `delay`."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "user_id", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("quantity"))


def on_superseded(evidence: DataFrame, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: findings whose evidence stands in the batch's superseded documents."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        sink(evidence.join(batch.select("document_id").distinct(), "document_id", "left_semi").select("finding_id").distinct(), batch_id)

    return handle


__all__ = ["document_stream", "on_superseded", "passage_stream", "passages", "usage_stream"]
