"""Language identification by language-bitmask n-gram filters.

Learning takes the most frequent character n-grams of each language, equally many for each, from a bounded sample of
labelled texts. They go into a bit-sliced Bloom filter: each slot holds one bit a language, so that the AND of an
n-gram's slots names all languages that contain it. A text's hits per language, corrected for the filter's false
positives, decide.

Defined cases: null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned;
a text whose n-grams are all unknown gets the most frequent language with score 0; ties go to the more frequent language
in learning, then to the smaller name; rows without id or language teach nothing; repeated rows get equal rows; other
columns pass through if kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, mix64, slices, unit_interval

#: Labelled rows of each language that are learned from: about this many, chosen by a hash of their id.
FIT_ROWS = 4_000
#: n-grams a language keeps, slots of the filter (a power of two) and look-ups an n-gram.
GRAMS, SLOTS, LOOKUPS = 20_000, 1 << 20, 3
SIZES = (3, 4)
#: Languages a plane of the filter; each plane has a 64-bit word a slot (8 MB).
PLANE = 64
#: Languages that are learned, the most frequent ones, and those of one filter (64 MB).
MOST_LANGUAGES, A_PASS = 1024, 512
SEED = 8128
_ODD = (np.random.default_rng(SEED).integers(1 << 62, size=8, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    table = np.full(0x110000, 32, dtype=np.uint32)
    for at in range(0x110000):
        c = chr(at)
        if c.isalpha():
            low = c.lower()
            table[at] = ord(low) if len(low) == 1 else at
    return table


def grams(data: bytes | None) -> np.ndarray:
    """Hashes of a text's n-grams over its letters, with one space at each word's edges; empty without a letter."""
    if not data:
        return np.empty(0, dtype=np.uint64)
    points = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype=np.uint32)
    points = _letters()[np.concatenate([[32], points, [32]])]
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint64)
    if len(points) < 3:  # " ", or no letter at all
        return np.empty(0, dtype=np.uint64)
    found = []
    for n in SIZES:
        if len(points) >= n:
            end = len(points) - n + 1
            total = np.full(end, np.uint64(n))
            for k in range(n):
                total += points[k : k + end] * _ODD[k]
            found.append(mix64(total))
    return np.concatenate(found)


class Filter:
    """Slots of language bits."""

    def __init__(self, languages: list[str], per_language: list[np.ndarray]):
        self.languages = languages
        self.planes = np.zeros((-(-len(languages) // PLANE), SLOTS), dtype=np.uint64)
        for k, hashes in enumerate(per_language):
            for at in self._places(hashes):
                np.bitwise_or.at(self.planes[k // PLANE], at, np.uint64(1 << k % PLANE))
        filled = np.array([((self.planes[k // PLANE] >> np.uint64(k % PLANE)) & np.uint64(1)).mean() for k in range(len(languages))])
        self.false_rate = filled**LOOKUPS

    @staticmethod
    def _places(hashes: np.ndarray) -> list[np.ndarray]:
        return [((hashes >> np.uint64(21 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(LOOKUPS)]

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """n-grams that each language contains, less the expected false positives."""
        places = self._places(hashes)
        masks = [np.bitwise_and.reduce([plane[at] for at in places]) for plane in self.planes]
        counts = np.array([np.count_nonzero(masks[k // PLANE] & np.uint64(1 << k % PLANE)) for k in range(len(self.languages))], dtype=float)
        return np.maximum(0, (counts - len(hashes) * self.false_rate) / (1 - self.false_rate))


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = FIT_ROWS) -> list[Filter]:
    """Filters of the MOST_LANGUAGES most frequent languages, A_PASS of them each, from about `most` rows of each language.

    These bounds are those of the labelled sample that is learned from: rows of rarer labels aren't in it. Languages are counted first,
    and the sample's rows are chosen by a join with the counts. Tasks send summed n-gram counts; at most GRAMS a language reach the driver.
    """
    known = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{lang}`").cast("string").alias("__lang"), F.col(f"`{text}`").alias("__t")).dropna(subset=["__id", "__lang"])
    sizes = known.groupBy("__lang").agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__lang").limit(MOST_LANGUAGES)
    sizes = materialise(sizes, "language-sizes")
    languages = [r["__lang"] for r in sizes.orderBy(F.desc("__n"), "__lang").collect()]  # MOST_LANGUAGES at most
    chosen = known.join(sizes, "__lang").filter(unit_interval("__id", seed=SEED) < F.lit(float(most)) / F.col("__n"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, most=16 << 20)):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for one in sorted(set(langs)):
                parts = [grams(x) for k, x in zip(langs, texts, strict=True) if k == one]
                hashes, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(hashes)), pa.array(hashes.view(np.int64)), pa.array(times.astype(np.int64))], names=schema.names)

    from pyspark.sql import Window

    summed = chosen.select("__lang", "__t").mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = materialise(summed.withColumn("rank", rank).filter(F.col("rank") <= GRAMS).select("lang", "gram"), "language-grams")
    filters = []
    for k in range(0, len(languages), A_PASS):
        some = languages[k : k + A_PASS]
        found = top.filter(F.col("lang").isin(some)).toPandas()
        per = dict(iter(found.groupby("lang")["gram"]))
        filters.append(Filter(some, [per[x].to_numpy(dtype=np.int64).view(np.uint64) if x in per else np.empty(0, dtype=np.uint64) for x in some]))
    discard(sizes, top)
    return filters


def identify(docs: DataFrame, trained: list[Filter], *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (default: all columns), lang_pred and score. No shuffle; a filter of up to 8 * A_PASS / PLANE MB is broadcast for each
    A_PASS languages, and texts run through them one after the other, with the best language so far and the sum of all hits."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    state = [T.StructField("__lang", T.StringType()), T.StructField("__best", T.DoubleType()), T.StructField("__sum", T.DoubleType())]
    row = F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in keep]).alias("__row")
    found = docs.select(F.col(f"`{text}`").cast("string").alias("__words_of"), row, F.lit("und").alias("__lang"), F.lit(0.0).alias("__best"), F.lit(0.0).alias("__sum"))
    for part in trained:
        held = docs.sparkSession.sparkContext.broadcast(part)
        schema = found.schema

        def run(batches, held=held, schema=schema):
            own = held.value
            for batch in (part for whole in batches for part in slices(whole, 0)):
                out = []
                for data, lang, best, total in zip(batch.column(0).cast(pa.binary()).to_pylist(), *[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                    hashes = grams(data)
                    if len(hashes):
                        counts = own.hits(hashes)
                        k = int(np.argmax(counts))  # languages are in the order that ties take
                        if lang == "und" or counts[k] > best:
                            lang, best = own.languages[k], float(counts[k])
                        total += float(counts.sum())
                    out.append((lang, best, total))
                columns = zip(*out, strict=True) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64()), strict=True)]], names=schema.names)

        found = found.mapInArrow(run, T.StructType([schema["__words_of"], schema["__row"], *state]))
    score = F.when(F.col("__sum") > 0, F.col("__best") / F.col("__sum")).otherwise(0.0)
    return found.select(*[F.col("__row")[c].alias(c) for c in keep], F.col("__lang").alias("lang_pred"), score.alias("score"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    trained = learn(docs.filter(~held_out))
    found = identify(docs.select("doc_id", "text"), trained, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
