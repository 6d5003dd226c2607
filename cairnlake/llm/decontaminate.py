"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `n` consecutive words of an item;
an item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

Up to `MOST_BROADCAST` bytes of items their windows are broadcast as sorted 64-bit hashes; hits are verified word by word.
Beyond, a bitmap of fixed size is broadcast instead: the document windows that pass it are joined with the items' windows
by hash and words, so that a benchmark of any size is exact and no worker holds more than the bitmap. That way is taken by
the size of the benchmark alone and gives the same rows.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no windows; equal
items keep their own ids; an item with a null id counts as a hit but is named in no list; empty tables give no
hits; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_TABLE, WordHashes, discard, materialise, mix64, scan_texts, slices, standing_on

N = 10
#: Bytes of benchmark text up to which its windows are one broadcast, of some 30 MB at most.
MOST_BROADCAST = 4 << 20
#: Bits of the bitmap for larger ones, 16 MB: at ten million windows one of thirteen document windows passes by chance.
BITS = 1 << 27
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_HASHES = WordHashes()
_ODD = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _words(data: bytes | None) -> list[bytes]:
    return data.translate(WORD_TABLE).split() if data else []


def _hashed(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(_HASHES.__getitem__, words)), dtype=np.uint64)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    end = len(hashes) - n + 1
    if end <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(end, np.uint64(n))
    for k in range(n):
        total += hashes[k : k + end] * _ODD[k % len(_ODD)] + np.uint64(k // len(_ODD))
    return mix64(total)


class Windows:
    """Exact look-up of item windows: sorted hashes by length, each with its item and place for the proof."""

    def __init__(self, items: list[tuple[object, str | None]], n: int):
        self.ids = [i for i, _ in items]
        self.texts = [(text or "").encode("utf-8", "surrogatepass") for _, text in items]
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for at, text in enumerate(self.texts):
            words = _words(text)
            if words:
                size = min(n, len(words))
                found.setdefault(size, []).append((_grams(_hashed(words), size), at))
        self.tables = {}
        for size, rows in found.items():
            hashes = np.concatenate([g for g, _ in rows])
            order = np.argsort(hashes, kind="stable")
            item = np.repeat(np.array([at for _, at in rows], dtype=np.int32), [len(g) for g, _ in rows])
            place = np.concatenate([np.arange(len(g), dtype=np.int32) for g, _ in rows])
            self.tables[size] = hashes[order], item[order], place[order]
        self._split: dict[int, list[bytes]] = {}

    def _item(self, at: int) -> list[bytes]:
        """An item's words; a few items are remembered, since hits of one mostly follow each other."""
        if at not in self._split:
            if len(self._split) > 64:
                self._split.clear()
            self._split[at] = _words(self.texts[at])
        return self._split[at]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word ranges inside occurrences, and the items they come from (by position)."""
        found, items = [], set()
        if not words or not self.tables:
            return found, items
        hashes = _hashed(words)
        for size, (known, item, place) in self.tables.items():
            grams = _grams(hashes, size)
            low = np.searchsorted(known, grams)
            for at in np.flatnonzero(known[np.minimum(low, len(known) - 1)] == grams):
                own, gram, k, hit = words[at : at + size], grams[at], int(low[at]), False
                while k < len(known) and known[k] == gram:
                    if self._item(int(item[k]))[place[k] : place[k] + size] == own:
                        items.add(int(item[k]))
                        hit = True
                    k += 1
                if hit:
                    found.append((int(at), int(at) + size))
        return _union(found), items

    def __getstate__(self):
        return self.__dict__ | {"_split": {}}


def _collected(items: DataFrame, item_id: str, item_text: str) -> list[tuple] | None:
    """The items, if their total, which is looked at first, is small enough to be broadcast."""
    rows = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("t is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0)).alias("b")).first()["b"]
    return [tuple(r) for r in rows.collect()] if total <= MOST_BROADCAST else None


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    n: int = N,
) -> DataFrame:
    """`keep` (default: all columns) and n_words, hit_ranges (word positions, end exclusive), hit_items (ids as strings)."""
    keep = docs.columns if keep is None else keep
    few = _collected(items, item_id, item_text)
    if few is None:
        return _by_join(docs, items.select(F.col(f"`{item_id}`").cast("string").alias("item"), F.col(f"`{item_text}`").cast("string").alias("t")), text, keep, n)
    held = docs.sparkSession.sparkContext.broadcast(Windows(few, n))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", RANGES), T.StructField("hit_items", T.ArrayType(T.StringType()))]

    def make():
        windows = held.value

        def work(texts):
            counts, spans, named = [], [], []
            for data in texts:
                words = _words(data)
                merged, at = windows.hits(words)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in merged])
                named.append(sorted({str(windows.ids[k]) for k in at if windows.ids[k] is not None}))
            return [counts, spans, named]

        return work

    return scan_texts(docs, text, keep, fields, make)


def _window_rows(df: DataFrame, schema: T.StructType, make: Callable) -> DataFrame:
    """Rows that `make()` gives for each (other column, text) of `df`, whose columns are those two."""

    def run(batches):
        rows_of = make()
        for batch in batches:
            for part in slices(batch, 1):
                rows = [row for a, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True) for row in rows_of(a, t)]
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    return df.mapInArrow(run, schema)


def _digest(column: F.Column) -> F.Column:
    return F.md5(F.coalesce(column, F.lit("")).cast("binary"))


def _by_join(docs: DataFrame, items: DataFrame, text: str, keep: list[str], n: int) -> DataFrame:
    """`contamination` for a benchmark of any size. Hits depend on the text alone, so they are joined back by its digest."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("size", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("words", T.BinaryType())])

    def of_item():
        def rows_of(item, data):
            words = _words(data)
            size = min(n, len(words))
            grams = _grams(_hashed(words), size).view(np.int64) if words else []
            return [(item, size, int(g), b" ".join(words[k : k + size])) for k, g in enumerate(grams)]

        return rows_of

    held_by = materialise(_window_rows(items.filter("t is not null").select("item", "t"), schema, of_item).distinct(), "leak-items")
    windows = materialise(held_by.select("size", "hash", "words").distinct(), "leak-windows")  # each once, whatever items share it
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # at most n
    slot = F.pmod("hash", F.lit(BITS)) + 1  # the functions count from 1
    rows = windows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    table = np.zeros(BITS // 8 + 8192, dtype=np.uint8)
    for bucket, bits in rows:  # BITS / 32768 of them at most
        start = (bucket - 1) * 4096
        table[start : start + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    held = spark.sparkContext.broadcast(table)
    found = T.StructType([T.StructField("digest", T.StringType()), T.StructField("places", T.ArrayType(T.LongType())), *schema.fields[1:]])

    def of_document():
        bits = held.value

        def rows_of(digest, data):
            words, out = _words(data), []
            hashes = _hashed(words)
            for size in sizes:
                grams = _grams(hashes, size)
                place = (grams.view(np.int64) % BITS).astype(np.int64)
                at = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                at = at[np.argsort(grams[at], kind="stable")]
                for same in np.split(at, np.flatnonzero(np.diff(grams[at].view(np.int64))) + 1) if len(at) else ():
                    out.append((digest, same.tolist(), size, int(grams[same[0]].view(np.int64)), b" ".join(words[same[0] : same[0] + size])))
            return out

        return rows_of

    own = F.col(f"`{text}`").cast("string")
    # a row for each different window of a text, with all its places: a frequent one is a row a document
    likely = _window_rows(docs.select(_digest(own).alias("digest"), own.alias("t")).filter("t is not null"), found, of_document)
    hits = materialise(likely.join(windows, ["hash", "size", "words"]).distinct(), "leak-found")  # copies of a text are one
    places = hits.select("digest", "size", F.explode_outer("places").alias("start")).select("digest", F.struct("start", (F.col("start") + F.col("size")).alias("end")).alias("r"))
    ranges = places.groupBy("digest").agg(F.array_sort(F.collect_set("r")).alias("ranges"))
    named = hits.select("digest", "size", "hash", "words").join(held_by, ["size", "hash", "words"]).groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("hit_items"))
    per = materialise(ranges.join(named, "digest", "left"), "leak-hits")
    discard(windows, held_by, hits)
    one = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))
    start = F.struct(F.array().cast(RANGES).alias("out"), one.alias("last"))

    def step(acc, r):
        joined = F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], r["end"]).alias("end"))
        closed = F.when(acc["last"]["end"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"])))
        return F.when(r["start"] <= acc["last"]["end"], F.struct(acc["out"].alias("out"), joined.alias("last"))).otherwise(F.struct(closed.alias("out"), r.alias("last")))

    merged = F.aggregate("ranges", start, step, lambda acc: F.concat(acc["out"], F.array(acc["last"])))
    per_text = per.select(F.col("digest").alias("__digest"), merged.alias("hit_ranges"), "hit_items")
    fresh = [c for c in keep if c not in ("n_words", "hit_ranges", "hit_items")]
    # texts without a word can't be hit: each has a key of its own, so that they aren't all one
    key = F.when(F.coalesce(F.length(own), F.lit(0)) == 0, F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string"))).otherwise(_digest(own))
    counted = scan_texts(docs.select(own.alias("__own"), key.alias("__digest"), *[F.col(f"`{c}`") for c in fresh]), "__own", ["__digest", *fresh], [T.StructField("n_words", T.LongType())], lambda: lambda texts: [[len(_words(x)) for x in texts]])
    joined = counted.join(per_text, "__digest", "left").drop("__digest")
    none = F.array().cast("array<string>")
    result = joined.select(*[F.col(f"`{c}`") for c in fresh], "n_words", F.coalesce("hit_ranges", F.array().cast(RANGES)).alias("hit_ranges"), F.coalesce("hit_items", none).alias("hit_items"))
    return standing_on(result, per)


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def n_hit() -> F.Column:
    return F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])


def remove_documents(docs: DataFrame, items: DataFrame, *, text: str = "text", n: int = N) -> DataFrame:
    """`docs` without those that any window of an item occurs in; columns as before."""
    aside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("__words_of"))
    marked = contamination(aside, items, text="__words_of", keep=["__row"], n=n)
    return marked.filter(F.size("hit_ranges") == 0).select("__row.*")


def _cut(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    places = [m.span() for m in _WORD.finditer(data)]
    for start, end in reversed(ranges):
        data = data[: places[start][0]] + data[places[end - 1][1] :]
    return data


def remove_spans(docs: DataFrame, items: DataFrame, *, text: str = "text", n: int = N) -> DataFrame:
    """`docs` with every hit word range cut from the text, again until no window is left; columns as before."""
    few = _collected(items, "item_id", "text")
    if few is None:
        return _remove_spans_by_join(docs, items, text, n)
    held = docs.sparkSession.sparkContext.broadcast(Windows(few, n))
    field = T.StructField(text, T.StringType())

    def make():
        def clean(data):
            while data and (merged := held.value.hits(_words(data))[0]):
                data = _cut(data, merged)
            return data

        return lambda texts: [[x if x is None else clean(x).decode("utf-8", "replace") for x in texts]]

    return scan_texts(docs, text, docs.columns, [field], make).select(*[F.col(f"`{c}`") for c in docs.columns])


def _remove_spans_by_join(docs: DataFrame, items: DataFrame, text: str, n: int) -> DataFrame:
    """Rounds of look-up and cut, until no text has a hit."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row")
    while True:
        aside = docs.select(row, F.col(f"`{text}`").cast("string").alias("__words_of"))
        marked = materialise(contamination(aside, items, text="__words_of", keep=["__row", "__words_of"], n=n), "leak-marked")
        schema = T.StructType([marked.schema["__row"], T.StructField("__cut", T.StringType())])

        def cut(batches, schema=schema):
            for batch in batches:
                for part in slices(batch, 1):
                    texts, ranges = part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist()
                    out = [t if t is None else _cut(t, [(r["start"], r["end"]) for r in rs]).decode("utf-8", "replace") for t, rs in zip(texts, ranges, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=schema.names)

        done = marked.select("__row", "__words_of", "hit_ranges").mapInArrow(cut, schema)
        docs = done.select(*[F.col("__cut").alias(c) if c == text else F.col(f"__row.`{c}`") for c in columns])
        if not marked.filter(F.size("hit_ranges") > 0).limit(1).count():
            return docs


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = contamination(docs, items, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_ranges") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM words, lengths WHERE len(w) >= n)
), found AS (SELECT r, p, grams.n, item_id FROM grams JOIN windows USING (n, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
          FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
