"""Passages and metrics of processed documents, replaced document by document as micro-batches arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import evidence_id
from ..operators.extraction import first_of_equal_metrics, passage_metrics
from ..operators.passages import lines


def processed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages and metrics of documents (document_id, version, text): passages by deterministic id, the first of equal ones of a document;
    one metric of a passage per key, value, unit and period. Of several rows of a document the last version counts."""
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("version"), F.desc(F.xxhash64("text"))))
    current = documents.withColumn("__last", last).filter("__last = 1").drop("__last")
    each = lines(current, doc_id="document_id", keep=("version",)).withColumn("passage_id", evidence_id(F.col("document_id"), F.lit(1), F.col("line")))
    row = F.struct("ordinal", "line", "version")
    passages = each.groupBy("document_id", "passage_id").agg(F.min(row).alias("first")).select("document_id", "passage_id", "first.*")
    told = passages.select("passage_id", F.lit("paragraph").alias("kind"), F.col("line").alias("text"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("struct<label:string,values:array<string>,headers:array<string>,caption:string>").alias("cells"), F.lit(1.0).alias("confidence"))
    metrics = first_of_equal_metrics(passage_metrics(told), passage="passage_id", order="place")
    return passages, metrics.join(passages.select("passage_id", "document_id"), "passage_id").drop("place")


def replace_documents(batch: DataFrame, path: str) -> None:
    """Write what a batch of documents holds to `path`/passages and `path`/metrics in place of what was there for them; a document without a
    line or value loses its rows. Nothing else changes, and the same batch again changes nothing: ids and rows follow from the documents.

    Partitions of documents are swapped whole by Spark's committer. A document's marker row keeps its partition there when it is empty.
    """
    batch = batch.persist()
    try:
        passages, metrics = processed(batch)
        keys = batch.select("document_id").distinct()
        for rows, name in ((passages, "passages"), (metrics, "metrics")):
            marked = keys.join(rows, "document_id", "left")  # a row of nulls for a document without any
            marked.repartition("document_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(f"{path}/{name}")
    finally:
        batch.unpersist()


def stored(spark, path: str, name: str) -> DataFrame:
    """The passages or metrics at `path`, without marker rows."""
    return spark.read.parquet(f"{path}/{name}").filter("passage_id IS NOT NULL")


def document_sink(documents: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream of documents into `path`. A batch that is run again after a failure writes the same partitions."""
    return documents.writeStream.foreachBatch(lambda batch, _: replace_documents(batch, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
