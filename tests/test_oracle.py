"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SF_DIR
from tomewright.queries import load

NAMES = sorted(name for name, (_, sql) in load().items() if sql)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cursor.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["p_partkey", "name", "school", "level"]


def test_stream_counts_every_event(spark):
    rows = __spark_entry__.queries()["stream_windowed_counts"](spark, SF_DIR).collect()
    events = spark.read.parquet(f"{SF_DIR}/events.parquet").where("ts is not null")
    assert len({(r.start, r.event_type) for r in rows}) == len(rows) and sum(r.n_events for r in rows) == events.count()
