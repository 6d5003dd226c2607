"""Ranks over a whole table without a window in one task: range partitions, a count for each, offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise, standing_on


def global_rank(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """`rows` and their rank from 1 in `order`, rows that are equal in it by their place in the input.

    Rows are range-partitioned and sorted once and written to the shared folder; the position in its partition is in the row.
    The driver sees one count a partition. Equal rows are parted too, so that a hot value isn't one task. An empty table
    gives no rows; nulls come where the order says; a column `name` of the input is replaced.
    """
    spark = rows.sparkSession
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    tied = rows.drop(name).withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    held = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranks")  # partition * 2**33 + position
    part = F.shiftright("__at", 33)
    counts = sorted(held.groupBy(part.alias("p")).count().collect())  # one row a partition
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    table = F.broadcast(spark.createDataFrame(offsets, "__part long, __before long"))
    placed = held.withColumn("__part", part).join(table, "__part")
    ranked = placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return standing_on(ranked.drop("__part", "__before", "__at"), held)


def evenly_spaced(rows: DataFrame, count: int, *order: Column | str) -> DataFrame:
    """`count` rows at equal distances in `order`: those at k * n div count for k from 0; all rows if there are no more than that."""
    ranked = global_rank(rows, *order, name="__rank")
    n = ranked.count()
    if n <= count:
        return ranked.drop("__rank")
    # the only k that can fall on a place is its own share of `count`, rounded up
    pick = F.expr(f"((__rank - 1) * {count}L + {n - 1}L) div {n}L")
    chosen = ranked.withColumn("__pick", pick).filter(F.expr(f"__pick < {count}L AND __pick * {n}L div {count}L = __rank - 1"))
    return chosen.drop("__rank", "__pick")
