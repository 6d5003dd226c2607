"""Exact quantiles of a whole column by rounds of histograms: no task sees more than its share, the driver a few thousand counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, materialise

#: Bins of a round, which is also the most rows that reach the driver in one.
BINS = 4096


def exact_quantile(rows: DataFrame, value: Column | str, q: float = 0.5) -> float | None:
    """The q-quantile with linear interpolation, as `percentile` gives it; null if there are no values. Nulls and NaN don't count.

    A round counts the values of each bin and its smallest and largest one; the bin that holds the wanted rank is the next round's
    range. Smallest and largest fall in different bins, so that each round narrows the range.
    """
    column = F.col(value) if isinstance(value, str) else value
    held = materialise(rows.select(column.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")), "quantile-values")
    n, low, high = held.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        lo, hi, before = low, high, 0
        while lo < hi:
            place = F.least(F.floor((F.col("v") / 2 - lo / 2) / F.lit((hi / 2 - lo / 2) / BINS)), F.lit(BINS - 1))  # halves don't overflow
            inside = held.filter((F.col("v") >= lo) & (F.col("v") <= hi))
            bins = sorted(inside.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: r["lo"])
            for r in bins:
                if before + r["n"] > rank:
                    lo, hi = r["lo"], r["hi"]
                    break
                before += r["n"]
        return lo

    place = q * (n - 1)
    first = at(int(place))
    found = first if place == int(place) else first + (at(int(place) + 1) - first) * (place - int(place))
    discard(held)
    return found
