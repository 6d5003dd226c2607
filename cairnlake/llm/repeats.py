"""Substring deduplication: words under a window that an earlier document also has are removed, found by a count-min prefilter.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a window is 50 consecutive words of one document. A word goes if a window
over it, as a word sequence, also starts in a document with a smaller id; windows are judged on the input.

1. A window's anchor is the smallest hash among its 35 runs of 16 words. Equal windows have equal anchors, so the count of an
   anchor is never below that of its windows, and neighbours share theirs: some 18 windows make one entry of the sketch.
   Every partition counts its documents' anchors in a count-min sketch of two rows, with counters that stop at two, and emits
   the touched pieces of it; the merged sketch can only overestimate. Its cells grow with the input up to `MOST_CELLS` bits a row.
2. A second pass takes the windows whose anchor is estimated at two or more. Runs of windows with one anchor are pieces. Equal
   pieces are grouped exactly: all but those of the smallest id lose all their windows. Windows of one anchor can only be in other
   pieces of that anchor, so only where an anchor has several different pieces, their windows are grouped too, one document a piece.
   The broadcast saves work and decides nothing: with a full sketch every window would be grouped, with the same result.
3. What a document loses is joined back to its text by id and text hash.

Keys of groups are pairs of 64-bit hashes (anchor and piece, anchor and window), so chance equality needs 128 equal bits.

Defined cases: null, empty and short texts lose nothing; a row without an id takes nothing away and loses nothing; rows
that share an id are one document as to order, so they take nothing from each other; equal rows get equal results; an empty
table gives no rows; long texts are split and hashed in slices; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, discard, materialise, mix64, scan_texts, slices

WINDOW, RUN = 50, 16
#: Sketch rows, cells a row for each byte of text, and the bounds of the cells of a row (32 MB of bits at most).
ROWS, CELLS_A_BYTE, LEAST_CELLS, MOST_CELLS = 2, 1 / 8, 1 << 20, 1 << 28
#: Cells of a piece of the sketch, anchors that a task gathers before it emits them, and words hashed together.
CHUNK, GATHERED, SEGMENT = 1 << 16, 1 << 21, 1 << 18
_TEXT_SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SEEDS = mix64(np.arange(11, 11 + ROWS, dtype=np.uint64))
_WORDS = WordHashes()


def word_slices(data: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of about a MB of text."""
    data, start = data or b"", 0
    while start < len(data):
        found = _SPACE.search(data, start + _TEXT_SLICE)
        end = found.start() if found else len(data)
        yield data[start:end].split()
        start = end


def word_hashes(data: bytes | None) -> np.ndarray:
    parts = [np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)) for words in word_slices(data)]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def _both(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """Hashes of sequences joined from one at i and another at i + gap."""
    n = min(len(left), len(right) - gap)
    return mix64(left[:n] * _LEFT + right[gap : gap + n] * _RIGHT) if n > 0 else np.empty(0, dtype=np.uint64)


def windows(words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first window, hashes, anchors) for each segment of a document's windows."""
    for start in range(0, max(0, len(words) - WINDOW + 1), SEGMENT):
        one = words[start : start + SEGMENT + WINDOW - 1]
        two = _both(one, one, 1)
        four = _both(two, two, 2)
        eight = _both(four, four, 4)
        run = _both(eight, eight, 8)
        whole = _both(_both(_both(run, run, 16), run, 32), two, 48)
        low, span = run, 1
        while span * 2 <= WINDOW - RUN + 1:  # the minimum of ever longer stretches
            low, span = np.minimum(low[:-span], low[span:]), span * 2
        rest = WINDOW - RUN + 1 - span
        low = np.minimum(low[: len(low) - rest], low[rest:])
        yield start, whole, low


def _cells(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(mix64(anchors ^ seed) & np.uint64(cells - 1)).astype(np.int64) for seed in _SEEDS]


def cells_for(n_bytes: int) -> int:
    """Cells of a sketch row for so much text, a power of two within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << int(np.ceil(np.log2(max(1.0, n_bytes * CELLS_A_BYTE))))))


_PIECE = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("at", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_MERGED = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("bits", T.BinaryType())])


def _sketch(texts: DataFrame, cells: int) -> DataFrame:
    """Pieces of the partitions' sketches: cells counted (two bytes each) and whether they were counted again."""

    def pieces(anchors: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(anchors)
        out = []
        for row, at in enumerate(_cells(every, cells)):
            found, count = np.unique(at, return_counts=True)
            chunk = found // CHUNK
            edges = np.flatnonzero(np.diff(chunk, prepend=-1))
            for a, b in zip(edges, [*edges[1:], len(found)], strict=True):
                out.append((row, int(chunk[a]), (found[a:b] % CHUNK).astype(np.uint16).tobytes(), np.packbits(count[a:b] > 1).tobytes()))
        for k in range(0, len(out), 1000):
            columns = zip(*out[k : k + 1000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=_PIECE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, load = [], 0
        for batch in batches:
            for part in slices(batch, 0):
                for data in part.column(0).cast(pa.binary()).to_pylist():
                    for _, _, anchors in windows(word_hashes(data)):
                        held.append(np.unique(anchors))
                        load += len(held[-1])
                if load >= GATHERED:
                    yield from pieces(held)
                    held, load = [], 0
        if load:
            yield from pieces(held)

    return texts.select(F.col("text").cast("string")).mapInArrow(run, _PIECE)


def _merge(pieces: DataFrame) -> DataFrame:
    """The cells counted twice or more of each chunk, merged one piece after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, count = None, None

        def finished():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([np.packbits(count > 1, bitorder="little").tobytes()])], names=_MERGED.names)

        for batch in batches:
            for row, chunk, at, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (row, chunk):
                    if now is not None:
                        yield finished()
                    now, count = (row, chunk), np.zeros(CHUNK, dtype=np.uint8)
                cells = np.frombuffer(at, dtype=np.uint16)
                more = 1 + np.unpackbits(np.frombuffer(twice, dtype=np.uint8), count=len(cells))
                count[cells] = np.minimum(2, count[cells] + more)
        if now is not None:
            yield finished()

    return pieces.repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(run, _MERGED)


class Sketch:
    """The merged sketch's bits: a cell is set where its count is two or more."""

    def __init__(self, cells: int, rows: list):
        self.cells, self.bits = cells, np.zeros((ROWS, cells // 8), dtype=np.uint8)
        for row, chunk, bits in rows:
            self.bits[row, chunk * CHUNK // 8 : (chunk + 1) * CHUNK // 8] = np.frombuffer(bits, dtype=np.uint8)

    def repeated(self, anchors: np.ndarray) -> np.ndarray:
        """Whether the estimate, the smallest of an anchor's counters, is at least two."""
        found = np.ones(len(anchors), dtype=bool)
        for bits, at in zip(self.bits, _cells(anchors, self.cells), strict=True):
            found &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _pieces(texts: DataFrame, sketch) -> DataFrame:
    """(anchor, piece, at, n, windows and the other columns) of windows that are estimated repeated; windows are 8 bytes each."""
    others = [f for f in texts.schema.fields if f.name != "text"]
    long = T.LongType()
    schema = T.StructType([*others, *[T.StructField(c, long) for c in ("anchor", "piece", "at", "n")], T.StructField("windows", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sketch.value
        for batch in batches:
            for part in slices(batch, 0):
                owner, anchors, keys, at, n, blobs = [], [], [], [], [], []
                for k, data in enumerate(part.column(0).cast(pa.binary()).to_pylist()):
                    for start, hashes, low in windows(word_hashes(data)):
                        take = np.flatnonzero(held.repeated(low))
                        if not len(take):
                            continue
                        w, a = hashes[take], low[take]
                        cut = np.flatnonzero((np.diff(take, prepend=-2) != 1) | np.concatenate([[True], a[1:] != a[:-1]]))
                        # no piece is longer than a window: its first and last window cover it
                        sizes = np.diff(cut, append=len(take))
                        more = -(-sizes // WINDOW)
                        step = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
                        first = np.repeat(cut, more) + step * WINDOW
                        size = np.diff(first, append=len(take))
                        last = first + size - 1
                        owner.append(np.full(len(first), k))
                        anchors.append(a[first])
                        keys.append(mix64(mix64(w[first] * _LEFT + w[last] * _RIGHT) + size.astype(np.uint64)))
                        at.append(start + take[first])
                        n.append(size)
                        blobs.append(w)
                if not owner:
                    continue
                rows, size = np.concatenate(owner), np.concatenate(n)
                for lo in range(0, len(rows), 20_000):
                    hi = min(len(rows), lo + 20_000)
                    blob = np.concatenate(blobs)[size[:lo].sum() : size[:hi].sum()].tobytes()
                    offsets = np.concatenate([[0], np.cumsum(size[lo:hi]) * 8]).astype(np.int32)
                    arrays = [part.column(1 + j).take(pa.array(rows[lo:hi])) for j in range(len(others))]
                    for column in (anchors, keys):
                        arrays.append(pa.array(np.concatenate(column)[lo:hi].view(np.int64)))
                    arrays += [pa.array(np.concatenate(at)[lo:hi].astype(np.int64)), pa.array(size[lo:hi].astype(np.int64))]
                    arrays.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(blob)]))
                    yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return texts.select("text", *[f.name for f in others]).mapInArrow(run, schema)


def _exploded(pieces: DataFrame) -> DataFrame:
    """(anchor, window, id, key, at) of the windows of pieces."""
    k = F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    each = pieces.select("anchor", "id", "key", "at", "windows", k.alias("k"))
    window = F.expr("substring(windows, int(k * 8 + 1), 8)")
    return each.select("anchor", window.alias("window"), "id", "key", (F.col("at") + F.col("k")).alias("at"))


def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, key, ranges): per document that loses words, the word ranges of its windows that an earlier document has; key hashes its text."""
    spark = docs.sparkSession
    own = F.col(f"`{text}`").cast("string")
    texts = docs.select(own.alias("text"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(own).alias("key")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    cells = cells_for(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = _merge(_sketch(texts, cells)).collect()  # at most MOST_CELLS / CHUNK rows of CHUNK bits for each sketch row
    held = spark.sparkContext.broadcast(Sketch(cells, rows))
    pieces = materialise(_pieces(texts, held), "repeat-pieces")
    lows = materialise(pieces.groupBy("anchor", "piece").agg(F.min("id").alias("low")), "repeat-lows")
    later = pieces.join(lows, ["anchor", "piece"]).filter(F.col("id") > F.col("low"))
    whole = later.select("id", "key", F.col("at").alias("start"), (F.col("at") + F.col("n") + WINDOW - 1).alias("end"))
    forked = lows.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor")
    first = lows.join(forked, "anchor").withColumnRenamed("low", "id")
    parted = materialise(_exploded(pieces.join(first, ["anchor", "piece", "id"])), "repeat-windows")
    least = parted.groupBy("anchor", "window").agg(F.min("id").alias("low"))
    lost = parted.join(least, ["anchor", "window"]).filter(F.col("id") > F.col("low"))
    ends = whole.unionByName(lost.select("id", "key", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end")))
    found = ends.groupBy("id", "key").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    made = materialise(found, "repeat-ranges")
    discard(pieces, lows, parted)
    return made


def _kept(n: int, ranges: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int64)
    for r in ranges or []:
        edge[r["start"]] += 1
        edge[r["end"]] -= 1
    return np.cumsum(edge)[:n] == 0


_COUNTED = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """`docs` with what each row loses."""
    found = repeats(docs, doc_id=doc_id, text=text).withColumnRenamed("id", "__id").withColumnRenamed("key", "__own")
    keyed = docs.withColumn("__key", F.xxhash64(F.col(f"`{text}`").cast("string")))
    return keyed.join(found, (F.col(f"`{doc_id}`") == F.col("__id")) & (F.col("__key") == F.col("__own")), "left").drop("__id", "__own", "__key").withColumnRenamed("ranges", "__ranges")


def _counted(docs: DataFrame, text: str, keep: list[str], kept_text: bool) -> DataFrame:
    """`keep` columns and n_words, n_removed and kept_sha256, or kept_text instead of these, of rows with __ranges."""
    keep = [k for k in keep if k not in {f.name for f in _COUNTED}]
    fields = _COUNTED[3:] if kept_text else _COUNTED[:3]
    schema = T.StructType([docs.schema[k] for k in keep] + fields)

    def of(data: bytes | None, ranges: list[dict] | None) -> tuple:
        n = sum(map(len, word_slices(data)))
        kept, digest, at, parts = _kept(n, ranges), hashlib.sha256(), 0, []
        any_ = False
        for words in word_slices(data):
            mine = [w for w, k in zip(words, kept[at : at + len(words)].tolist(), strict=True) if k]
            at += len(words)
            if mine:
                joined = (b" " if any_ else b"") + b" ".join(mine)
                any_ = True
                if kept_text:
                    parts.append(joined)
                else:
                    digest.update(joined)
        if kept_text:
            return (None if data is None else data.decode() if not ranges else b"".join(parts).decode(),)
        return n, int(n - kept.sum()), digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in slices(batch, 0):
                rows = [of(*r) for r in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=schema.names)

    return docs.select(F.col(f"`{text}`").cast("string").alias("__text"), "__ranges", *[F.col(f"`{k}`") for k in keep]).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with what is left of each text that loses words, words parted by one space; other texts are as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__row")
    joined = _joined(docs, doc_id, text).select(F.col(f"`{text}`").alias("__text"), "__ranges", row)
    cut = _counted(joined, "__text", ["__row"], kept_text=True)
    return cut.select(*[F.col("kept_text").alias(text) if c == text else F.col("__row")[c].alias(c) for c in docs.columns])


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _counted(_joined(docs, "doc_id", "text"), "text", ["doc_id"], kept_text=False)


OP12_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS s, w FROM d WHERE len(w) >= 50),
y AS (SELECT doc_id, s, md5(array_to_string(w[s : s + 49], ' ')) AS h FROM x),
z AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) < doc_id AS gone FROM y),
g AS (SELECT doc_id, list(s) AS starts FROM z WHERE gone GROUP BY doc_id),
p AS (SELECT g.doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS places FROM g),
k AS (SELECT d.doc_id, w, coalesce(places, []) AS places FROM d LEFT JOIN p USING (doc_id)),
r AS (SELECT doc_id, w, len(places) AS n_removed, coalesce(map_from_entries(list_transform(places, lambda i: {'k': i, 'v': true})), MAP {}) AS m FROM k)
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: m[i] IS NULL), ' '), '')) AS kept_sha256
FROM r
"""
