"""Every query against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tidegauge.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


def canon(v):
    return f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted([canon(r[c]) for c in columns] for r in df.collect())
    assert mine == sorted([canon(v) for v in r] for r in found.fetchall())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["t", "event_type", "state"] and rows.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cooldown_is_greedy(spark):
    told = {}
    for r in catalogue.QUERIES["cooldown_emit"](spark, FOLDER).collect():
        told.setdefault(r["user_id"], []).append(r["t"])
    times = {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").where("event_type = 'error'").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) u").orderBy("u").collect():
        kept = times.setdefault(r["user_id"], [])
        if not kept or r["u"] - kept[-1] >= 12 * catalogue.HOUR:
            kept.append(r["u"])
    assert {k: sorted(v) for k, v in told.items()} == times
