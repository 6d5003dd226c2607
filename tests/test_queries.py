"""Every query with an oracle gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import pytest

from cairnlake.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(row[k]) for k in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_oracle(spark, database, name):
    frame = registry.QUERIES[name](spark, SF)
    found = database.execute(registry.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_rate_limit_replay_against_a_plain_fold(spark):
    import duckdb

    want, hits = {}, {}
    for user, event, at in duckdb.execute(f"SELECT user_id, event_id, epoch_us(ts) FROM '{SF}/events.parquet' ORDER BY ts, event_id").fetchall():
        held = [h for h in hits.get(user, []) if h > at - 3_600_000_000]
        want[event] = len(held) < 2
        hits[user] = [*held, at] if want[event] else held
    assert {r["event_id"]: r["accepted"] for r in registry.QUERIES["rate_limit_replay"](spark, SF).collect()} == want
