"""Event folds: reviews, runs, applicability, queues, metering, limits, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import period_of_label

#: Plan limits (fixed values); None is unlimited.
PLANS = [("explorer", 3, 10, 150, 15), ("professional", 50, 500, 600, 300), ("enterprise", None, None, None, None)]


def latest(rows: DataFrame, *, by: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The last row of each group by a total order, as one aggregation rather than a sort per group."""
    key = F.struct(*order)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*value), key).alias("last")).select(*by, *[F.col(f"last.{c}").alias(c) for c in value])


def previous(rows: DataFrame, *, by: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the row before, within a group."""
    return rows.withColumn(f"previous_{value}", F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def fold_reviews(reviews: DataFrame) -> DataFrame:
    """Last accept or override per finding wins; comments only count. `reviews`: finding_id, seq, decision."""
    deciding = F.col("decision").isin("accept", "override")
    return reviews.groupBy("finding_id").agg(
        F.coalesce(F.max_by(F.when(deciding, F.col("decision")), F.when(deciding, F.col("seq"))), F.lit("unreviewed")).alias("state"),
        F.count_if(F.col("decision") == "comment").alias("comments"),
        F.count("*").alias("reviews"),
    )


def top_per_group(rows: DataFrame, *, by: str, order: list[Column], each: int, overall: int) -> DataFrame:
    """At most `each` rows of a group, then the first `overall` of all."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= each).drop("__rank").orderBy(*order).limit(overall)


def usage_month_to_date(events: DataFrame, as_of: str) -> DataFrame:
    """Quantity per account and kind since the start of `as_of`'s month, up to it."""
    start, end = F.date_trunc("month", F.to_timestamp(F.lit(as_of))), F.to_timestamp(F.lit(as_of))
    now = F.col("ts").cast("timestamp")
    return events.filter((now >= start) & (now < end)).groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count("*").alias("n"))


def usage_pivot(events: DataFrame, kinds: list[str]) -> DataFrame:
    """One column per kind; the kinds are given, so no job looks for them."""
    return events.groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_type")).na.fill(0, kinds)


def window_counts(events: DataFrame, seconds: int) -> DataFrame:
    """How many events of the same key the last `seconds` hold, the event included."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    window = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(window))


def precision_recall(predicted: Column, gold: Column) -> list[Column]:
    """Counts, precision, recall and F1; 0 where a denominator is 0."""
    tp, fp, fn = F.count_if(predicted & gold), F.count_if(predicted & ~gold), F.count_if(~predicted & gold)
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1")]


def citation_check(cited: DataFrame, valid: DataFrame, *, by: str, ids: str) -> DataFrame:
    """Distinct cited ids, those that don't exist and the valid share. `cited`: by, ids (array); `valid`: id."""
    spread = cited.select(by, F.explode(F.array_distinct(ids)).alias("id")).join(valid.select("id", F.lit(True).alias("found")), "id", "left")
    grouped = spread.groupBy(by).agg(F.array_sort(F.collect_list("id")).alias("all"), F.array_sort(F.collect_list(F.when(F.col("found").isNull(), F.col("id")))).alias("bad"))
    return grouped.select(by, F.array_join("all", ",").alias("cited"), F.array_join("bad", ",").alias("invalid"), F.round(1 - F.size("bad") / F.size("all"), 3).alias("valid_share"))


#: Modes of a run, and document statuses that a run waits for (fixed values).
MODES, PENDING = ("rules", "hybrid"), ("uploaded", "processing")


def requested_runs(requests: DataFrame, companies: DataFrame, documents: DataFrame, sets: DataFrame, usage: DataFrame, *, models: bool = False) -> DataFrame:
    """Requests for runs (request_id, company_id, set_id, mode, period) with accepted, the first reason against it, and the period's days.

    `companies` has company_id and fiscal_year_end; `documents` company_id, document_id and status of current documents; `sets` set_id; `usage`
    company_id, used and allowed runs (null: unlimited). Checked in this order: set, mode, whether a model is there, period, documents, those
    still in progress (three are named), those that are ready, quota. All requests are checked by the same joins.
    """
    per = documents.groupBy("company_id").agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "ready").alias("ready"), F.slice(F.array_sort(F.collect_set(F.when(F.col("status").isin(*PENDING), F.col("document_id").cast("string")))), 1, 3).alias("pending"),
    )
    joined = requests.join(companies, "company_id", "left").join(sets.select("set_id", F.lit(True).alias("known")).distinct(), "set_id", "left").join(per, "company_id", "left").join(usage, "company_id", "left")
    joined = joined.withColumn("found", period_of_label(F.col("period"), F.col("fiscal_year_end")))
    reason = F.coalesce(
        F.when(F.col("known").isNull(), "unknown requirement set"), F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "unknown mode"), F.when((F.col("mode") == "hybrid") & F.lit(not models), "no model is configured"),
        F.when(F.col("found").isNull(), F.concat(F.lit("period not understood: "), F.coalesce("period", F.lit("none")))), F.when(F.coalesce("documents", F.lit(0)) == 0, "no documents"),
        F.when(F.size("pending") > 0, F.concat(F.lit("still in progress: "), F.array_join("pending", ", "))), F.when(F.col("ready") == 0, "no document is ready"), F.when(F.col("used") >= F.col("allowed"), "no runs left"),
    )
    staged = joined.withColumn("reason", reason)
    days = [F.when(F.col("reason").isNull(), F.col(f"found.{c}")).alias(f"period_{c}") for c in ("label", "start", "end")]
    return staged.select("request_id", "company_id", "set_id", "mode", F.col("reason").isNull().alias("accepted"), "reason", *days)
