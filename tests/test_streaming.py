"""Windowed counts of the event stream against a batch count."""

from pyspark.sql import functions as F

import __spark_entry__
from tests.conftest import SF_DIR


def test_every_window_is_counted(spark):
    got = {(r.start, r.event_type): r.n_events for r in __spark_entry__.queries()["stream_windowed_counts"](spark, SF_DIR).collect()}
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    start = F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start")
    assert got == {(r.start, r.event_type): r["count"] for r in events.groupBy(start, "event_type").count().collect()}
