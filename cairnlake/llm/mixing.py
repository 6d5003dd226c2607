"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words: its weight's share of all words, at most `MOST_REPEATS` times its own, what is
over being shared again by weight. Document rates minimise the entropy sum of w (r log r - r), w = size + mean size,
under one token constraint a source, sum of r * size = target, and 0 <= r <= MOST_REPEATS. The dual is convex with one
variable a source: r = min(MOST_REPEATS, exp(tilt * size / (size + mean size))). Newton steps on it are aggregations
over (source, size) counts, which hold a row for each distinct size of a source, not for each document. The sources' numbers are a
table too, so that there may be as many sources as documents.

Rates are rounded to whole copies by a hash of the id, then the copies nearest to rounding otherwise are moved up or
down until the source's words meet its target; that cut is found by two rounds of histograms, so no source is ever
sorted in one task.

Defined cases: null and wordless texts have size 0 and one copy; a null source is a source of its own, last in order;
sources without words have target 0; an empty table gives no rows; repeated rows share their rate; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import global_rank
from .common import discard, materialise, unit_interval

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
STEPS, TOLERANCE = 40, 1e-7
SEED = 271828
COARSE, FINE = 1 << 10, 1 << 20


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _tilted(tilt: str, mean: str, full: str) -> F.Column:
    size = F.col("__mix_size")
    rate = F.exp(F.col(tilt) * size / (size + F.col(mean)))
    return F.when(F.col(full), F.lit(float(MOST_REPEATS))).otherwise(F.least(F.lit(float(MOST_REPEATS)), F.coalesce(rate, F.lit(1.0))))


def _targets(sources: DataFrame) -> DataFrame:
    """Adds __mix_target to (__mix_words, __mix_weight) rows: all words shared by weight, none above MOST_REPEATS times its own.

    A source is full where level * weight reaches that; a rising level is found by one sum over the sources a step.
    """
    most = MOST_REPEATS * F.col("__mix_words")
    able, total = F.col("__mix_words") > 0, None
    level = None
    while True:
        full = able & (F.lit(level) * F.col("__mix_weight") >= most) if level is not None else F.lit(False)
        held, free, words = sources.agg(F.sum(F.when(full, most)), F.sum(F.when(able & ~full, F.col("__mix_weight"))), F.sum("__mix_words")).first()
        total = words or 0
        rising = (total - (held or 0)) / free if free else level
        if level is not None and rising is not None and rising <= level or not free:
            break
        level = rising
    share = F.lit(level) * F.col("__mix_weight") if level is not None else F.lit(0.0)
    return sources.withColumn("__mix_target", F.when(able, F.least(share, most.cast("double"))).otherwise(0.0))


def _tilts(counts: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds __mix_tilt and __mix_full by safeguarded Newton steps on the dual, which has one variable a source.

    The state of all sources is a table; a step is one join with the (source, size) counts and one aggregation by source.
    """
    endless = float("inf")
    full = F.col("__mix_target") >= MOST_REPEATS * F.col("__mix_words") * (1 - 1e-12)
    state = sources.withColumns({"__mix_full": full, "__mix_tilt": F.lit(0.0), "low": F.lit(-endless), "high": F.lit(endless)})
    state = materialise(state.withColumn("open", ~full & (F.col("__mix_target") > 0)), "mix-state")
    z = F.col("__mix_size") / (F.col("__mix_size") + F.col("__mix_mean"))
    rate = _tilted("__mix_tilt", "__mix_mean", "__mix_full")
    words = F.col("__mix_size") * F.col("n") * rate
    for _ in range(STEPS):
        if not state.filter("open").limit(1).count():
            break
        going = state.filter("open").select("__mix_source", "__mix_tilt", "__mix_mean", "__mix_full")
        sums = counts.join(going, "__mix_source").groupBy("__mix_source").agg(F.sum(words).alias("w"), F.sum(F.when(rate < MOST_REPEATS, words * z).otherwise(0.0)).alias("d"))
        both = state.join(sums, "__mix_source", "left")
        w, d, goal, tilt = (F.col(c) for c in ("w", "d", "__mix_target", "__mix_tilt"))
        close = F.abs(w - goal) <= TOLERANCE * goal
        both = both.withColumn("open", F.col("open") & ~F.coalesce(close, F.lit(False)))
        both = both.withColumns({"low": F.when(F.col("open") & (w < goal), F.greatest("low", tilt)).otherwise(F.col("low")), "high": F.when(F.col("open") & (w >= goal), F.least("high", tilt)).otherwise(F.col("high"))})
        step = F.when((d > 0) & (w > 0), tilt - (F.log(w) - F.log(goal)) * w / d)
        middle = F.when((F.col("low") > -endless) & (F.col("high") < endless), (F.col("low") + F.col("high")) / 2).when(w < goal, F.col("low") + 8).otherwise(F.col("high") - 8)
        moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
        before = state
        state = materialise(both.withColumn("__mix_tilt", F.when(F.col("open"), moved).otherwise(tilt)).drop("w", "d"), "mix-state")
        discard(before)
    # sums of doubles differ by their order: what is used doesn't
    return state.withColumn("__mix_tilt", F.round("__mix_tilt", 6)).drop("low", "high", "open", "__mix_weight")


def solve(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame | None:
    """One row a source: its numbers, tilt and rounding cut. `sized` has __mix_name, __mix_size and __mix_u."""
    by_size = materialise(sized.groupBy("__mix_name", "__mix_size").agg(F.count("*").alias("n")), "mix-sizes")
    totals = by_size.groupBy("__mix_name").agg(F.sum(F.col("__mix_size") * F.col("n")).alias("__mix_words"), F.sum("n").alias("__mix_docs"))
    ranked = global_rank(totals, F.asc_nulls_last("__mix_name"), name="__mix_source")  # by code point
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("__mix_source") - 1, F.lit(len(weights))) + 1).cast("int"))
    mean = F.greatest(F.col("__mix_words") / F.col("__mix_docs"), F.lit(1.0))
    sources = materialise(ranked.withColumns({"__mix_weight": weight, "__mix_mean": mean}).drop("__mix_docs"), "mix-sources")
    if not sources.limit(1).count():
        return None
    names = sources.select("__mix_source", F.col("__mix_name").alias("__mix_key"))
    counts = by_size.join(names, F.col("__mix_name").eqNullSafe(F.col("__mix_key"))).select("__mix_source", "__mix_size", "n")
    counts = materialise(counts, "mix-counts")
    discard(by_size)
    return _cuts(sized, _tilts(counts, _targets(sources)))


def _rounded(sized: DataFrame, state: DataFrame) -> DataFrame:
    """Adds the rate and its first rounding. `state` is a row a source; Spark broadcasts it where it is small."""
    small = state.withColumnRenamed("__mix_name", "__mix_key")
    joined = sized.join(small, sized["__mix_name"].eqNullSafe(small["__mix_key"])).drop("__mix_key")
    value = F.col("__mix_rate") + F.col("__mix_u")
    return (
        joined.withColumn("__mix_rate", _tilted("__mix_tilt", "__mix_mean", "__mix_full"))
        .withColumn("__mix_floor", F.floor(value).cast("long"))
        .withColumn("__mix_part", value - F.floor(value))
    )


def _distance() -> F.Column:
    """How far a document is from being rounded otherwise, in (0, 1]; null if it can't be."""
    up = F.when((F.col("__mix_floor") < MOST_REPEATS) & (F.col("__mix_size") > 0), 1 - F.col("__mix_part"))
    down = F.when((F.col("__mix_floor") > 0) & (F.col("__mix_size") > 0), F.col("__mix_part"))
    return F.when(F.col("__mix_up"), up).otherwise(down)


def _place(distance: F.Column) -> tuple[F.Column, F.Column]:
    at = F.floor(distance * F.lit(float(COARSE * FINE)))
    return F.floor(at / FINE).cast("long"), (at % FINE).cast("long")


def _cuts(sized: DataFrame, state: DataFrame) -> DataFrame:
    """Adds to each source's row which way to move copies, and up to where."""
    state = state.withColumns({"__mix_up": F.lit(True), "__mix_need": F.lit(0.0)})
    took = _rounded(sized, state).groupBy("__mix_source").agg(F.sum(F.col("__mix_floor") * F.col("__mix_size")).alias("took"))
    state = materialise(
        state.join(took, "__mix_source", "left").withColumns({
            "__mix_up": F.coalesce(F.col("took"), F.lit(0)) < F.col("__mix_target"),
            "__mix_need": F.abs(F.col("__mix_target") - F.coalesce(F.col("took"), F.lit(0))),
        }).drop("took"),
        "mix-way",
    )
    coarse, fine = _place(_distance())
    placed = _rounded(sized, state).withColumns({"__mix_coarse": coarse, "__mix_fine": fine}).dropna(subset=["__mix_coarse"])
    sums = placed.groupBy("__mix_source", "__mix_coarse", "__mix_need").agg(F.sum("__mix_size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("__mix_source").orderBy("__mix_coarse"))  # COARSE rows a source at most
    edge = (
        sums.withColumn("upto", upto)
        .filter(F.col("upto") - F.col("w") < F.col("__mix_need"))
        .groupBy("__mix_source")
        .agg(F.max("__mix_coarse").alias("__mix_edge"), F.max_by(F.col("__mix_need") - (F.col("upto") - F.col("w")), "__mix_coarse").alias("__mix_rest"))
    )
    state = materialise(state.join(edge, "__mix_source", "left"), "mix-edge")
    within = _rounded(sized, state).withColumns({"__mix_coarse": coarse, "__mix_fine": fine}).filter(F.col("__mix_coarse") == F.col("__mix_edge"))
    sums = within.groupBy("__mix_source", "__mix_fine", "__mix_rest").agg(F.sum("__mix_size").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("__mix_source").orderBy("__mix_fine"))  # FINE rows a source at most
    cut = sums.withColumn("upto", upto).filter(F.col("upto") - F.col("w") / 2 <= F.col("__mix_rest")).groupBy("__mix_source").agg(F.max("__mix_fine").alias("__mix_cut"))
    return materialise(state.join(cut, "__mix_source", "left"), "mix-cut")


def _copies(sized: DataFrame, state: DataFrame) -> DataFrame:
    coarse, fine = _place(_distance())
    moved = (coarse < F.col("__mix_edge")) | ((coarse == F.col("__mix_edge")) & (fine <= F.coalesce(F.col("__mix_cut"), F.lit(-1))))
    change = F.when(F.coalesce(moved, F.lit(False)), F.when(F.col("__mix_up"), 1).otherwise(-1)).otherwise(0)
    copies = F.when(F.col("__mix_size") == 0, F.lit(1)).otherwise(F.col("__mix_floor") + change)
    return _rounded(sized, state).withColumn("__mix_copies", copies.cast("long"))


def _sized(docs: DataFrame, doc_id: str, text: str, source: str, keep: list[F.Column]) -> DataFrame:
    return docs.select(
        *keep,
        F.col(f"`{source}`").cast("string").alias("__mix_name"),
        word_count(F.col(f"`{text}`")).alias("__mix_size"),
        unit_interval(F.col(f"`{doc_id}`"), seed=SEED).alias("__mix_u"),
    )


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per row: the id, size, source_size, target, source, rate and copies."""
    kind = docs.schema[doc_id].dataType
    sized = materialise(_sized(docs, doc_id, text, source, [F.col(f"`{doc_id}`").alias("__mix_id")]), "mix-docs")
    state = solve(sized, weights)
    if state is None:
        fields = [(doc_id, kind), ("size", T.LongType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("source", T.StringType()), ("rate", T.DoubleType()), ("copies", T.LongType())]
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(*x) for x in fields]))
    names = {"__mix_id": doc_id, "__mix_size": "size", "__mix_words": "source_size", "__mix_target": "target", "__mix_name": "source", "__mix_rate": "rate", "__mix_copies": "copies"}
    return _copies(sized, state).select(*[F.col(a).alias(b) for a, b in names.items()])


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """`docs` with each row as often as the mixture takes it; columns as before, no shuffle of texts."""
    narrow = materialise(_sized(docs, doc_id, text, source, []), "mix-docs")
    state = solve(narrow, weights)
    if state is None:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    taken = _copies(_sized(docs, doc_id, text, source, [row]), state).filter(F.col("__mix_copies") > 0)
    return taken.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies").cast("int")))).select("__row.*")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")
