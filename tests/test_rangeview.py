"""Views stored in ranges, and caches with digests."""

import os
import random

from pyspark.sql import functions as F

from tomewright.operators.rangeview import RangeView
from tomewright.sources.cache import damaged, intact, repaired, sealed


def places(view):
    return [(r.k, r.i) for r in view.read().orderBy("place").collect()], sorted(r.place for r in view.read().collect())


def test_inserts_touch_their_ranges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), i) for i in range(400)]
    view = RangeView(spark, str(tmp_path / "v"), ["k", "i"])
    view.build(spark.createDataFrame(rows[:300], "k int, i int"), rows_per_range=40)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert places(view) == (sorted(rows[:300], key=key), list(range(1, 301)))
    folders = set(os.listdir(tmp_path / "v" / "data"))
    more = [(20, 1000 + i) for i in range(30)]
    touched = view.insert(spark.createDataFrame(more, "k int, i int"))
    assert 1 <= len(touched) <= 2 and len(set(os.listdir(tmp_path / "v" / "data")) - folders) == 1
    assert places(view) == (sorted(rows[:300] + more, key=key), list(range(1, 331)))
    view.insert(spark.createDataFrame(rows[300:] + [(None, -5), (99, 1)], "k int, i int"))
    everything = sorted([*rows, *more, (None, -5), (99, 1)], key=key)
    assert places(view) == (everything, list(range(1, len(everything) + 1)))
    assert view.insert(spark.createDataFrame([], "k int, i int")) == []
    gone = view.delete(F.col("k").between(10, 12))
    left = [r for r in everything if r[0] is None or not 10 <= r[0] <= 12]
    assert 1 <= len(gone) < 8 and places(view) == (left, list(range(1, len(left) + 1)))
    assert view.delete(F.col("k") == 1000) == []
    view.delete(F.lit(True))
    assert view.read().count() == 0
    view.insert(spark.createDataFrame(more, "k int, i int"))
    assert places(view)[1] == list(range(1, 31))


def test_an_empty_view(spark, tmp_path):
    view = RangeView(spark, str(tmp_path / "v"), ["k", "i"])
    view.build(spark.createDataFrame([], "k int, i int"))
    assert view.read().collect() == [] and view.delete(F.lit(True)) == []
    view.insert(spark.createDataFrame([(2, 1), (1, 1)], "k int, i int"))
    assert places(view) == ([(1, 1), (2, 1)], [1, 2])


def test_damaged_entries_are_computed_anew(spark):
    cache = sealed(spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string").withColumn("stored_at", F.current_timestamp()))
    hurt = cache.withColumn("v", F.when(F.col("k") == 3, "x").otherwise(F.col("v"))).withColumn("digest", F.when(F.col("k") == 4, None).otherwise(F.col("digest")))
    assert sorted(r.k for r in damaged(hurt).collect()) == [3, 4] and sorted(r.k for r in intact(hurt).collect()) == [1, 2]
    wanted = spark.createDataFrame([(1,), (2,), (3,), (5,)], "k int")
    new = repaired(wanted, hurt, "k", lambda lost: lost.withColumn("v", F.lit("new")))
    assert {(r.k, r.v) for r in new.collect()} == {(1, "a"), (2, None), (3, "new"), (5, "new")}
    assert damaged(new).count() == 0
