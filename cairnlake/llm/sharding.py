"""Sharding by sampled splitters, under the law `bytes`: shards of near equal size.

A row's key is a hash of its text followed by a hash of its id, so that equal texts are neighbours. A size-weighted
sample of the keys gives quantile boundaries of many more ranges than shards; each range's true bytes are then summed
and overfull ranges (a large group of copies, say) are subdivided by samples of their own. Consecutive ranges fill the
shards by cumulated bytes. Within a range rows are numbered by key; the ranges' counts make the slots gapless.

Defined cases: a null text counts as empty, its size is the overhead alone; rows that are equal in text and id share a
key and stay in one range; an empty table gives no rows; with fewer rows than shards some shards stay empty; extra
columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, unit_interval

SHARDS = 40
#: Ranges a shard, sampled keys a range, and how much fuller than planned a range may be before it is subdivided.
RANGES, SAMPLES, OVERFULL = 64, 12, 3.0
OVERHEAD = 16
ROUNDS = 4
SEED = 31337
_LOW = (1 << 24) - 1


@dataclass
class Splitters:
    """Boundaries (a key at or above one lies right of it) and per range its shard and first slot."""

    bounds: np.ndarray
    shard: np.ndarray
    first: np.ndarray


def sort_key(text: F.Column, doc_id: F.Column) -> F.Column:
    return F.xxhash64(text).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64(doc_id).bitwiseAND(F.lit(_LOW)))


def _range_of(bounds: np.ndarray, spark):
    held = spark.sparkContext.broadcast(bounds)  # RANGES * shards numbers and what subdivision adds

    @F.pandas_udf(T.IntegerType())
    def find(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, keys.to_numpy(), side="right").astype(np.int32))

    return find


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    keys, upto = keys[order], np.cumsum(weights[order])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[np.minimum(at, len(keys) - 1)])


def split(keyed: DataFrame, shards: int = SHARDS) -> Splitters | None:
    """Plan over `keyed` (__key, __size); what reaches the driver is bounded by RANGES * SAMPLES * shards."""
    spark = keyed.sparkSession
    total = keyed.agg(F.sum("__size").alias("b")).first()["b"]
    if not total:
        return None
    parts = shards * RANGES
    even = total / parts

    def sample(rows: DataFrame, each: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys drawn in proportion to size, one for every `each` bytes, and what each stands for."""
        drawn = rows.filter(unit_interval("__key", "__tie", seed=seed) < F.col("__size") / F.lit(each)).select("__key", "__size").toPandas()
        return drawn["__key"].to_numpy(dtype=np.int64), np.maximum(drawn["__size"].to_numpy(dtype=float), each)

    keys, weights = sample(keyed, even / SAMPLES, SEED)
    bounds = np.unique(_quantiles(keys, weights, parts) & ~_LOW) if len(keys) else np.empty(0, dtype=np.int64)  # copies stay together
    for turn in range(ROUNDS):
        ranged = keyed.withColumn("__range", _range_of(bounds, spark)("__key"))
        found = ranged.groupBy("__range").agg(F.sum("__size").alias("b"), F.count("*").alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high")).toPandas()
        over = found[(found["b"] > OVERFULL * even) & (found["low"] < found["high"])]
        if not len(over) or turn == ROUNDS - 1:
            break
        keys, weights = sample(ranged.filter(F.col("__range").isin(over["__range"].tolist())), even / SAMPLES, SEED + 1 + turn)
        where = np.searchsorted(bounds, keys, side="right")
        finer = [_quantiles(keys[where == r], weights[where == r], int(np.ceil(b / even))) for r, b in zip(over["__range"], over["b"], strict=True) if (where == r).any()]
        bounds = np.unique(np.concatenate([bounds, *finer]))
    size, count = np.zeros(len(bounds) + 1), np.zeros(len(bounds) + 1, dtype=np.int64)
    size[found["__range"]], count[found["__range"]] = found["b"], found["n"]
    middle = np.cumsum(size) - size / 2
    shard = np.minimum(shards - 1, (middle * shards / size.sum()).astype(np.int64))
    before = np.cumsum(count) - count
    return Splitters(bounds, shard, before - before[np.searchsorted(shard, shard)])


def assign(rows: DataFrame, plan: Splitters, keep: list[str]) -> DataFrame:
    """`keep`, shard and slot for rows with __key: one shuffle by range, each range a bounded share of a shard."""
    spark = rows.sparkSession
    places = spark.createDataFrame([(k, int(s), int(f)) for k, (s, f) in enumerate(zip(plan.shard, plan.first, strict=True))], "__range int, __shard int, __first long")
    ranged = rows.withColumn("__range", _range_of(plan.bounds, spark)("__key"))
    numbered = ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__range").orderBy("__key", "__tie")))
    placed = numbered.join(F.broadcast(places), "__range")
    return placed.select(*keep, F.col("__shard").alias("shard"), (F.col("__first") + F.col("__at") - 1).alias("slot"))


def _keyed(docs: DataFrame, doc_id: str, text: str, more: list[F.Column]) -> DataFrame:
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        sort_key(whole, F.col(f"`{doc_id}`")).alias("__key"),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("__size"),
        F.col(f"`{doc_id}`").alias("__tie"),
        *more,
    )


def shard_documents(docs: DataFrame, *, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` and their shard and slot."""
    plan = split(materialise(_keyed(docs, doc_id, text, []), "shard-keys"), shards)
    others = [c for c in docs.columns if c not in ("shard", "slot")]
    if plan is None:
        return docs.select(*[F.col(f"`{c}`") for c in others], F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row")
    return assign(_keyed(docs, doc_id, text, [row]), plan, ["__row"]).select("__row.*", "shard", "slot")


def op8_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    narrow = materialise(_keyed(docs, "doc_id", "text", [F.col("doc_id"), crc]), "shard-keys")  # texts aren't moved
    plan = split(narrow)
    if plan is None:
        placed = narrow.select("doc_id", "__size", "text_crc32", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    else:
        placed = assign(narrow, plan, ["doc_id", "__size", "text_crc32"])
    return placed.select("doc_id", F.col("__size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
