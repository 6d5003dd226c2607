"""Near-duplicate detection: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

Text is lower-cased in A-Z; words are `[^\\x20\\x09-\\x0D]+`; a document's set is that of its distinct 5-word shingles (the
whole sequence if it has fewer words), held as 64-bit hashes. Documents link with 100 * intersection >= 75 * union.

1. Documents with equal sets are one class from the start (by a 128-bit digest); the rest works on one of each class.
2. SuperMinHash gives each set 128 registers: every element visits the registers in a random order of its own with
   ranks that grow, so an element stops as soon as no register can still fall. 32 bands of 4 registers: a pair with
   similarity 0.75 shares no band once in 200,000 times.
3. In each bucket the members are verified against one centre, not all pairs. Linked members form components; buckets
   within one component are done. In those that hold several, elements are counted: an element of one document alone is
   in no intersection, which rules out most heavily edited copies without a look at any pair. Rounds follow in which
   each document meets the centres of two of its buckets, first those with the fewest elements of their own, which are the
   nearest to all copies of a text; what then remains is paired by the prefix principle: two linked sets share one of the
   rarest elements of each, fewer of them the more its sets have of their own, so that documents which only share a common
   passage never meet. Per element, members outside the largest component meet all members; pairs within it aren't made.
4. Candidates pass a bound from their set sizes and a 128-bit sketch (five standard deviations wide), then links are
   confirmed on the full sets.
5. Links are grouped by alternating stars.

Each step is a table in the shared folder, deleted once nothing later reads it. Workers hold a slice of texts at a time.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; a null id has component null and
is kept; rows that share an id are one document, which stands for its set of the smallest digest where it is the first
of several sets; an empty table gives no rows; extra columns pass through in `keep_one_each` and are ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, discard, materialise, mix64, scan_texts, slices, standing_on
from .components import components

SHINGLE = 5
PART, WHOLE = 75, 100
REGISTERS, BANDS = 128, 32
ROWS = REGISTERS // BANDS
#: Of the sketch's 128 bits 16 differ at similarity 0.75 on average, with a standard deviation of 3.7.
MOST_DIFFERENT_BITS = 40
#: Rounds with other centres at most (they end when one finds no link), and the buckets whose centre a document meets in one.
MOST_ROUNDS, CENTRES = 2, 2
#: Elements that are signed together.
ELEMENTS = 1 << 15
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_ODD = mix64(np.arange(1, 9, dtype=np.uint64) * _GOLDEN) | np.uint64(1)
_WORDS = WordHashes()


def shingles(data: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = np.array(list(map(_WORDS.__getitem__, words)), dtype=np.uint64)
    if len(words) < SHINGLE:
        return mix64((hashes * _ODD[: len(words)]).sum(dtype=np.uint64, keepdims=True) + _ODD[5] * np.array([len(words)], dtype=np.uint64))
    end = len(words) - SHINGLE + 1
    total = np.zeros(end, dtype=np.uint64)
    for k in range(SHINGLE):
        total += hashes[k : k + end] * _ODD[k]
    return np.unique(mix64(total))


def signatures(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SuperMinHash registers of each set, one row a set; infinite where a set is empty.

    In step j an element draws the next register of its own random order (Fisher-Yates) and offers j plus a fraction.
    A set stops once all its registers hold less than j + 1: later offers can't lower them.
    """
    sizes = np.array([len(s) for s in sets])
    rows = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), sizes)
    seeds = mix64(np.concatenate([*sets, np.empty(0, dtype=np.uint64)]))
    steps = np.arange(1, m + 1, dtype=np.uint64) * _GOLDEN
    order = None
    for j in range(m):
        if not len(owner):
            break
        draw = mix64(seeds + steps[j])
        pick = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        offer = j + (draw >> np.uint64(32)).astype(np.float64) * 2.0**-32
        if j == 0:
            place, first = pick, pick
        else:
            every = np.arange(len(owner))
            place = order[every, pick].copy()
            order[every, pick] = order[every, j]
        np.minimum.at(rows.reshape(-1), owner * m + place, offer)
        going = np.flatnonzero(rows.max(axis=1) >= j + 1)
        keep = np.isin(owner, going)
        owner, seeds = owner[keep], seeds[keep]
        if j == 0:
            order = np.tile(np.arange(m, dtype=np.int16), (len(owner), 1))
            first = first[keep]
            order[np.arange(len(owner)), first] = 0  # register 0 takes the place of the one just drawn
        else:
            order = order[keep]
    return rows


def _sign(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (one row a set) and the 128-bit sketch as two numbers a set."""
    bits = signatures(sets).view(np.uint64)
    grouped = bits.reshape(len(sets), BANDS, ROWS)
    keys = mix64((grouped * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + (np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN))
    low = (mix64(bits) & np.uint64(1)).reshape(len(sets), 2, 64)
    sketch = (low << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), sketch.view(np.int64)


_LONG = T.LongType()


def fingerprints(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """id, n (set size), d1, d2 (digest of the set), s1, s2 (sketch) and bands of each document."""
    fields = [T.StructField(c, _LONG) for c in ("n", "d1", "d2", "s1", "s2")] + [T.StructField("bands", T.ArrayType(_LONG))]

    def make():
        def work(texts):
            count = len(texts)
            n, digest = np.zeros(count, dtype=np.int64), np.zeros((count, 2), dtype=np.uint64)
            keys, sketch = np.zeros((count, BANDS), dtype=np.int64), np.zeros((count, 2), dtype=np.int64)
            held, at, load = [], [], 0
            for k, data in enumerate(texts):
                found = shingles(data)
                n[k] = len(found)
                for side in (0, 1):
                    digest[k, side] = mix64(found ^ _ODD[side]).sum(dtype=np.uint64)
                held.append(found)
                at.append(k)
                load += len(found)
                if load >= ELEMENTS or k == count - 1:
                    keys[at], sketch[at] = _sign(held)
                    held, at, load = [], [], 0
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[n > 0].reshape(-1)))
            digest = digest.view(np.int64)
            return [n, digest[:, 0], digest[:, 1], sketch[:, 0], sketch[:, 1], bands]

        return work

    named = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).filter("id is not null")
    return scan_texts(named, "t", ["id"], fields, make)


def _likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b) whose marks allow a link."""
    one = marks.select(*[F.col(c).alias(f"{c}_a" if c != "id" else "a") for c in MARKS])
    two = marks.select(*[F.col(c).alias(f"{c}_b" if c != "id" else "b") for c in MARKS])
    return pairs.join(one, "a").join(two, "b").filter(_may_link("_a", "_b")).select("a", "b")


#: A set's size, the elements that some other open set has too (all of them where that isn't known yet), and its sketch.
MARKS = ["id", "n", "s", "s1", "s2"]


def _may_link(x: str, y: str) -> F.Column:
    """An intersection is within both sets' shared elements, whatever remains of either is in the union."""
    n, s, s1, s2 = ((F.col(f"{c}{x}"), F.col(f"{c}{y}")) for c in MARKS[1:])
    common = F.least(*s)
    near = F.bit_count(s1[0].bitwiseXOR(s1[1])) + F.bit_count(s2[0].bitwiseXOR(s2[1])) <= MOST_DIFFERENT_BITS
    return near & (WHOLE * common >= PART * (n[0] + n[1] - common)) & (WHOLE * F.least(*n) >= PART * F.greatest(*n))


def _confirmed(pairs: DataFrame, pool: DataFrame) -> DataFrame:
    """(a, b) of the pairs that link on their full sets. Rows mostly come sorted by a, whose set is made once then."""
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])
    one, two = pool.select(F.col("id").alias("a"), F.col("t").alias("ta")), pool.select(F.col("id").alias("b"), F.col("t").alias("tb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")

    def run(batches):
        last, own = object(), np.empty(0, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch, 2, 3):
                ids, left, right = part.column(0).to_pylist(), part.column(2), part.column(3).cast(pa.binary()).to_pylist()
                linked = np.zeros(len(ids), dtype=bool)
                for k, (a, data) in enumerate(zip(ids, right, strict=True)):
                    if a != last:
                        last, own = a, shingles(left[k].cast(pa.binary()).as_py())
                    other = shingles(data)
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    linked[k] = WHOLE * common >= PART * (len(own) + len(other) - common) and common > 0
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(linked))

    return both.mapInArrow(run, schema)


def _merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after more links: only the components that they join are grouped, and `grouped` is renamed."""
    first, second = (grouped.select(F.col("id").alias(end), F.col("component").alias(f"c{end}")) for end in ("a", "b"))
    ends = links.join(first, "a").join(second, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(ends)
    joined = grouped.join(found.select(F.col("id").alias("component"), F.col("component").alias("least")), "component", "left")
    after = materialise(joined.select("id", F.coalesce("least", "component").alias("component")), "near-components")
    discard(found, grouped)
    return after


def _torn(rows: DataFrame, key: str) -> DataFrame:
    """The rows (with a component) of keys that hold more than one component."""
    several = rows.groupBy(key).agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return rows.join(several.select(key), key)


def _known_elements(pool: DataFrame, members: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, element, times) of elements that several members have, and the marks of members that can link at all.

    Counts are joined back to the elements: both sides are shuffled by element, partial counts before that.
    """

    def make():
        return lambda texts: [[shingles(x).view(np.int64) for x in texts]]

    held = scan_texts(pool.join(members, "id", "left_semi"), "t", ["id"], [T.StructField("elements", T.ArrayType(_LONG))], make)
    sets = materialise(held, "near-open-sets")
    rows = sets.select("id", F.explode("elements").alias("element"))
    counts = rows.groupBy("element").agg(F.count("*").alias("times")).filter("times > 1")
    known = materialise(rows.join(counts, "element"), "near-known")
    discard(sets)
    able = marks.drop("s").join(known.groupBy("id").agg(F.count("*").alias("s")), "id").filter(WHOLE * F.col("s") >= PART * F.col("n"))
    return known, materialise(able.select(*MARKS), "near-marks")


def _by_prefix(known: DataFrame, grouped: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b) of different components that share an element among the rarest of each and whose marks allow a link.

    Two linked sets have `least` = ceil(75 / 175 of the sum of their sizes) elements in common, so one of the
    n - least + 1 first ones of either in any order common to all sets. By frequency, elements of its own come first
    and pair with nothing, a passage that many documents share comes last. A set's own longest such prefix, with a
    partner of 75 % of its size, is what is looked up; each pair is held to its own sizes' shorter ones.
    """
    rank = F.row_number().over(Window.partitionBy("id").orderBy("times", "element"))
    place = rank + F.col("n") - F.col("s")
    longest = F.col("n") - F.ceil(F.col("n") * F.lit(PART) / F.lit(WHOLE)) + 1
    rare = known.join(marks, "id").withColumn("place", place).filter(F.col("place") <= longest)
    torn = materialise(_torn(rare.select(*MARKS, "element", "place").join(grouped, "id"), "element"), "near-rare")
    sizes = torn.groupBy("element", "component").agg(F.count("*").alias("times"))
    largest = sizes.groupBy("element").agg(F.max_by("component", F.struct("times", "component")).alias("largest"))
    outside = torn.join(largest, "element").filter("component <> largest").drop("largest")
    other = torn.select("element", *[F.col(c).alias(f"{c}_") for c in (*MARKS, "place", "component")])
    least = F.ceil((F.col("n") + F.col("n_")) * F.lit(PART) / F.lit(WHOLE + PART))
    held = (F.col("place") <= F.col("n") - least + 1) & (F.col("place_") <= F.col("n_") - least + 1)
    met = outside.join(other, "element").filter((F.col("component") != F.col("component_")) & held & _may_link("", "_"))
    pairs = met.select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
    return standing_on(pairs, torn)


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (set size) and component of each document with an id; component is the smallest id reachable."""
    prints = materialise(fingerprints(docs, doc_id, text), "near-prints")
    equal = materialise(prints.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id")), "near-equal")
    # one row a set, then one a document: the second only matters where rows of one id have several sets
    firsts = prints.join(equal, ["n", "d1", "d2", "id"], "left_semi").groupBy("id").agg(F.min(F.struct("n", "d1", "d2", "s1", "s2", "bands")).alias("p"))
    single = materialise(firsts.select("id", "p.n", "p.s1", "p.s2", "p.bands"), "near-single")
    rows = single.select("id", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("members"), F.min("id").alias("centre")).filter("members > 1")
    shared = materialise(rows.join(buckets.select("bucket", "centre"), "bucket"), "near-buckets")
    ids = materialise(shared.select("id").distinct(), "near-ids")
    every = materialise(single.select("id", "n", F.col("n").alias("s"), "s1", "s2").join(ids, "id", "left_semi"), "near-marks")
    pool = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).join(ids, "id", "left_semi")
    pool = materialise(pool, "near-texts")
    discard(single)
    to_centre = shared.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    tested = [materialise(_likely(to_centre, every), "near-tested")]
    links = materialise(_confirmed(tested[0], pool), "near-links")
    grouped = _merged(materialise(ids.select("id", F.col("id").alias("component")), "near-components"), links)
    discard(ids, links)
    open_ids = _torn(shared.select("bucket", "id").join(grouped, "id"), "bucket").select("id").distinct()
    known, marks = _known_elements(pool, open_ids, every)
    # of the documents with a bucket, how small a part of their sets is their own: the least edited of copies is nearest to all
    alone = marks.select("id", ((F.col("n") - F.col("s")) / F.col("n")).alias("alone"))
    still = materialise(shared.select("bucket", "id").join(alone, "id"), "near-open")
    discard(shared, every)
    for turn in range(MOST_ROUNDS):
        torn = _torn(still.join(grouped, "id"), "bucket")
        turn_order = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("bucket", F.lit(turn))))
        first = F.xxhash64("id", F.lit(turn)) if turn else F.struct("alone", "id")
        centre = torn.groupBy("bucket").agg(F.min_by(F.struct(F.col("id").alias("c"), F.col("component").alias("cc")), first).alias("centre"))
        some = torn.withColumn("turn", turn_order).filter(F.col("turn") <= CENTRES)
        across = some.join(centre, "bucket").filter("component <> centre.cc")
        pairs = across.select(F.least("id", "centre.c").alias("a"), F.greatest("id", "centre.c").alias("b")).distinct()
        grouped, found = _test(pairs, marks, tested, pool, grouped)
        if not found:
            break
    rare = _by_prefix(known, grouped, marks)
    grouped, _ = _test(rare, None, tested, pool, grouped)
    discard(known, marks, still, rare, pool, *tested)
    heads = equal.join(grouped.withColumnRenamed("component", "found"), "id", "left")
    heads = heads.select("n", "d1", "d2", F.coalesce("found", "id").alias("component"))
    joined = prints.select("id", "n", "d1", "d2").join(heads, ["n", "d1", "d2"], "left")
    return standing_on(joined.select("id", "n", F.coalesce("component", "id").alias("component")), prints, equal, grouped)


def _test(pairs: DataFrame, marks: DataFrame | None, tested: list[DataFrame], pool: DataFrame, grouped: DataFrame) -> tuple[DataFrame, bool]:
    """The components after the likely ones of new pairs are confirmed, and whether any were. `tested` gains the pairs.

    Without `marks` the pairs are likely ones already.
    """
    likely = pairs if marks is None else _likely(pairs, marks)
    for before in tested:
        likely = likely.join(before, ["a", "b"], "left_anti")
    fresh = materialise(likely, "near-tested")
    tested.append(fresh)
    more = materialise(_confirmed(fresh, pool), "near-links")
    found = bool(more.limit(1).count())
    if found:
        grouped = _merged(grouped, more)
    discard(more)
    return grouped, found


def keep_one_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one document of each class, that of the smallest id, once; rows without an id stay; columns as before."""
    found = classes(docs, doc_id=doc_id, text=text)
    kept = materialise(found.filter("id = component").select(F.col("id").alias("__id")).distinct(), "near-kept")
    discard(found)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{doc_id}`").alias("__id"))
    once = F.row_number().over(Window.partitionBy("__id").orderBy(F.xxhash64("__row")))
    named = whole.filter("__id is not null").join(kept, "__id").withColumn("__at", once).filter("__at = 1")
    return named.select("__row").unionByName(whole.filter("__id is null").select("__row")).select("__row.*")


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = classes(docs)
    nameless = docs.filter("doc_id is null")
    rows = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
    counted = fingerprints(nameless.select(F.lit(0).alias("doc_id"), "text"), "doc_id", "text")
    none = counted.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return rows.unionByName(none)


OP9_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  WITH RECURSIVE r(id, to_id) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.id, e.t FROM r JOIN (SELECT a AS f, b AS t FROM links UNION ALL SELECT b, a FROM links) e ON e.f = r.to_id
  ) SELECT id, min(to_id) AS component_id FROM r GROUP BY id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reach ON reach.id = d.doc_id
"""
