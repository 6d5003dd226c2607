"""Exact replay of a sliding-window limiter: only accepted hits count, so the state is a fold over each key's events."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "user_id long, event_id long, at_micros long, accepted boolean"
STATE = "hits array<long>"


def fold(hits: list[int], events: Iterable[tuple[int, int]], limit: int, window: int) -> tuple[list[int], list[bool]]:
    """Accept an event if fewer than `limit` accepted ones lie within `window` microseconds before it."""
    verdicts = []
    for at, _ in events:
        hits = [h for h in hits if h > at - window]
        verdicts.append(len(hits) < limit)
        if verdicts[-1]:
            hits.append(at)
    return hits, verdicts


def limited(events: DataFrame, *, limit: int, seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Verdicts for a stream of (user_id, event_id, ts).

    State per key is at most `limit` times, whatever the number of events; a key that stays silent for a window, by
    event time and `delay`, is forgotten. Events within a batch are taken in time order, as the limiter met them.
    """
    window = seconds * 1_000_000
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    keyed = timed.select("user_id", "event_id", "ts", F.unix_micros("ts").alias("at_micros"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["at_micros", "event_id"], kind="stable")
        hits, verdicts = fold(hits, zip(rows["at_micros"], rows["event_id"], strict=True), limit, window)
        state.update((hits,))
        last = int(rows["at_micros"].max()) // 1000
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield rows.assign(accepted=verdicts)[["user_id", "event_id", "at_micros", "accepted"]]

    return keyed.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def limited_batch(events: DataFrame, *, limit: int, seconds: int) -> DataFrame:
    """The same verdicts over a finished table: partitions sorted by key and time are folded batch by batch.

    What is held of a key is its accepted times within a window, at most `limit`, however many events it has.
    """
    window = seconds * 1_000_000
    keyed = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_micros"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, hits = object(), []
        for rows in frames:
            verdicts = []
            for key, at in zip(rows["user_id"], rows["at_micros"], strict=True):
                if key != user:
                    user, hits = key, []
                hits, said = fold(hits, [(at, 0)], limit, window)
                verdicts += said
            yield rows.assign(accepted=verdicts)[["user_id", "event_id", "at_micros", "accepted"]]

    dealt = keyed.repartition("user_id").sortWithinPartitions("user_id", "at_micros", "event_id")
    return dealt.mapInPandas(run, OUTPUT)
