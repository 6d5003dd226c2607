"""Importance resampling towards a target: hashed n-gram features, log-ratio weights, Gumbel top-k without replacement.

Text is lower-cased in A-Z; words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; features are all runs of 1 to 3 consecutive
words, joined by one space, repeats counted. A feature's bucket is its CRC-32 modulo `BUCKETS`. A bucket's gain is the
logarithm of its smoothed share in the target over that in the source, a document's weight the sum over its features; the weight
plus Gumbel noise from the id is the score, and the highest scores are drawn.

1. CRC-32 by a position table. The remainder is linear, so a byte's contribution depends only on its value and its distance
   from the feature's end: `TABLE[distance, byte]`. A slice's words are laid out once with single spaces, features are spans of it;
   their bytes' contributions are gathered and folded by one `bitwise_xor.reduceat`, and a constant for the length (the remainder
   of as many zero bytes) is added. A span longer than the table is folded block by block, each block moving the remainder so far
   on by the table's own last rows.
2. Counts: each task sums its buckets, 10,000 numbers, which Spark adds up; only these reach the driver, which makes the gains.
3. Weights: a second scan with the gains broadcast. Then only narrow rows move: a global rank by range partitions finds the drawn ones.

Defined cases: null, empty and wordless texts have no features, weight 0 and aren't drawn; a row without an id has neither noise
nor score nor rank and doesn't count among those to draw from; rows that share an id share the noise and may be drawn both;
an empty table gives no rows, an empty target only zeros as t; whole texts of any length; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import global_rank
from .common import WORD_TABLE, materialise, scan_texts, slices

BUCKETS, LONGEST = 10_000, 3
LEAST_WORDS, SHARE, SEED = 20, 5, 42
#: Rows of the position table, which is also the length of a block of a long span.
REACH = 1024
#: Words whose features are hashed together.
SEGMENT = 1 << 14


def _position_table() -> np.ndarray:
    """TABLE[d, b]: the remainder of byte b followed by d zero bytes, from a zero remainder."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(0xEDB88320), first >> 1).astype(np.uint32)
    table = np.empty((REACH, 256), dtype=np.uint32)
    table[0] = first
    for d in range(1, REACH):
        table[d] = (table[d - 1] >> np.uint32(8)) ^ first[table[d - 1] & np.uint32(255)]
    return table


TABLE = _position_table()
_FLAT = TABLE.reshape(-1)
#: The CRC-32 of so many zero bytes: what the initial and final inversions add for a length.
CONSTANT = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], dtype=np.uint32)


def _remainders(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span's bytes; spans hold 1 to REACH bytes."""
    size = end - start
    first = np.cumsum(size) - size
    # the distance from the span's end falls by one a byte, the place in the data rises by one
    shift = np.repeat(start - first, size)
    place = np.arange(len(shift)) + shift
    distance = np.repeat(end - 1, size) - place
    return np.bitwise_xor.reduceat(_FLAT[(distance << 8) | data[place]], first)


def _moved_on(remainder: np.ndarray) -> np.ndarray:
    """Remainders after REACH more zero bytes: their four bytes are the contributions of a block's first four."""
    out = np.zeros_like(remainder)
    for k in range(4):
        out ^= TABLE[REACH - 1 - k, (remainder >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span [start, end) of `data` (uint8); no span is empty."""
    size = end - start
    out = np.empty(len(start), dtype=np.uint32)
    short = size <= REACH
    if short.any():
        out[short] = _remainders(data, start[short], end[short]) ^ CONSTANT[size[short]]
    long = np.flatnonzero(~short)
    if len(long):
        at = start[long] + (size[long] - 1) % REACH + 1
        found = _remainders(data, start[long], at)
        while len(going := np.flatnonzero(at < end[long])):  # whole blocks are left
            found[going] = _moved_on(found[going]) ^ _remainders(data, at[going], at[going] + REACH)
            at[going] += REACH
        constants = {n: zlib.crc32(bytes(n)) for n in set(size[long].tolist())}
        out[long] = found ^ np.array([constants[n] for n in size[long].tolist()], dtype=np.uint32)
    return out


def features(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of the features of some texts, segment by segment."""
    norms = [b" ".join(t.translate(WORD_TABLE).split()) if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(n for n in norms if n), dtype=np.uint8)
    if not len(data):
        return
    gaps = np.flatnonzero(data == 32)
    start, end = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    text_end = np.cumsum([len(n) + 1 for n in norms if n])
    owner = np.array([k for k, n in enumerate(norms) if n])[np.searchsorted(text_end, start, side="right")]
    for lo in range(0, len(start), SEGMENT):
        hi = min(len(start), lo + SEGMENT)
        for n in range(LONGEST):
            first = np.arange(lo, min(hi, len(start) - n))
            first = first[owner[first] == owner[first + n]]
            if len(first):
                yield owner[first], (span_crcs(data, start[first], end[first + n]) % np.uint32(BUCKETS)).astype(np.int64)


_COUNT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
_SLICE = 1 << 18


def bucket_counts(df: DataFrame, text: str = "text") -> np.ndarray:
    """How many features each bucket holds over all rows; each task emits one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0, most=_SLICE):
                for _, buckets in features(part.column(0).cast(pa.binary()).to_pylist()):
                    total += np.bincount(buckets, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=_COUNT.names)

    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, _COUNT).groupBy("bucket").agg(F.sum("n")).collect():  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the target's smoothed share over the source's, for each bucket."""
    all_source, all_target = source.sum() + BUCKETS, target.sum() + BUCKETS
    ratio = (target + 1).astype(float) * float(all_source) / ((source + 1).astype(float) * float(all_target))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, target: DataFrame, *, text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (default: all) and n_words, n_features and weight of each row of `docs`."""
    held = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(docs, text), bucket_counts(target, target_text)))  # BUCKETS numbers
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]

    def make():
        gain = held.value

        def work(texts):
            sums = np.zeros((2, len(texts)), dtype=np.int64)
            for lo, hi in _runs(texts):
                for owner, buckets in features(texts[lo:hi]):
                    sums[0, lo:hi] += np.bincount(owner, minlength=hi - lo)
                    np.add.at(sums[1], owner + lo, gain[buckets])
            # n words have n + (n - 1) + (n - 2) features
            words = np.where(sums[0] > 1, (sums[0] + LONGEST) // LONGEST, sums[0])
            return [pa.array(words), pa.array(sums[0]), pa.array(sums[1])]

        return work

    return scan_texts(docs, text, docs.columns if keep is None else keep, fields, make)


def _runs(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about _SLICE bytes."""
    lo, load = 0, 0
    for k, t in enumerate(texts):
        load += len(t or b"")
        if load >= _SLICE:
            yield lo, k + 1
            lo, load = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of each row of `docs`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__own"))
    weighed = weigh(named, target, text="__own", target_text=target_text, keep=["doc_id"])
    scored = weighed.withColumn("score", F.col("weight") + noise)
    scored = materialise(scored.withColumn("__open", F.col("score").isNotNull() & (F.col("n_words") >= LEAST_WORDS)), "resample-scores")
    draw = scored.filter("__open").count() * SHARE // 100
    ranked = global_rank(scored, F.desc("__open"), F.desc("score"), F.asc("doc_id"))
    rank = F.when(F.col("__open") & (F.col("rank") <= draw), F.col("rank"))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def drawn(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """The drawn rows of `docs`, whole, with `rank`; ids must be unique, as rows are found by id."""
    ranks = resample(docs, target, doc_id=doc_id, text=text, target_text=target_text).filter("rank IS NOT NULL").select(F.col("doc_id").alias(doc_id), "rank")
    return docs.drop("rank").join(ranks, doc_id)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the bytes of distinct features.
OP13_SQL = """
WITH tbl AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))
),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
),
words AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM texts
),
grams AS (
  SELECT side, id, unnest(w) AS f FROM words
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1
  UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words WHERE len(w) > 2
),
counted AS (SELECT side, id, f, count(*) AS c FROM grams GROUP BY ALL),
hexed AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
crcs AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2), lambda i: (strpos('0123456789ABCDEF', x[i]) - 1) * 16 + strpos('0123456789ABCDEF', x[i + 1]) - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, tbl
),
placed AS (SELECT side, id, bucket, sum(c) AS c FROM counted JOIN crcs USING (f) GROUP BY ALL),
sides AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t FROM placed GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sides),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS g FROM sides, totals),
weights AS (SELECT id AS doc_id, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT d.id AS doc_id, len(d.w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words d LEFT JOIN weights w ON w.doc_id = d.id WHERE d.side = 'd'
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n >= 20)
SELECT s.doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN r <= 5 * ranked.n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
