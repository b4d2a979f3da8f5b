"""Versioned tables, saved lists and catalogues by content."""

import os

import pytest
from pyspark.sql import functions as F

from tomewright.operators import percolate as pc
from tomewright.plans.search import Dialect
from tomewright.sources.liststore import ListStore, members, read_lists
from tomewright.sources.snapshot import current_index, read_snapshot, vacuum, write_snapshot
from tomewright.sources.versions import MARKERS, Conflict, VersionedTable, latest, publish

RAW = [
    ("a", '{"sources": ["X"], "prepared": ["p", "q"], "query": [[["red", "!x"]]], "game": "one"}'),
    ("b", '{"sources": [], "prepared": ["q"], "filter": [[["x"]]]}'),
    ("c", '{"sources": [], "query": [[["x"]]]}'),
    ("d", '{"sources": "X", "prepared": [], "query": "red"}'),
    ("e", "no json"),
    ("f", None),
]


@pytest.fixture
def lists(spark):
    return read_lists(spark.createDataFrame(RAW, "list string, raw string"), "classic")


def test_import_and_rejects(lists):
    good, bad = lists
    assert {(r.list, r.game) for r in good.collect()} == {("a", "one"), ("b", "classic")}
    assert {r.list for r in bad.collect()} == {"c", "d", "e", "f"}


def test_upsert_and_delete(spark, lists, tmp_path):
    store, good = ListStore(spark, str(tmp_path / "lists")), lists[0]
    assert store.read().collect() == []
    store.upsert(good)
    changed = good.where("list = 'a'").withColumn("game", F.lit("two")).unionByName(good.where("list = 'b'").withColumn("list", F.lit("z")))
    store.upsert(changed)
    assert {(r.list, r.game) for r in store.read().collect()} == {("a", "two"), ("b", "classic"), ("z", "classic")}
    store.delete(spark.createDataFrame([("b",), ("nothing",)], "list string"))
    assert sorted(r.list for r in store.index(["two", "classic"]).collect()) == ["a", "z"]
    assert {tuple(r) for r in store.prepared().collect()} == {("a", "p"), ("a", "q"), ("z", "q")}
    again, bad = read_lists(store.exported(), "other")
    assert bad.count() == 0 and again.exceptAll(store.read().select(again.columns)).count() == 0
    rows = spark.createDataFrame([(1, "p"), (2, "r"), (3, None)], "id long, name string")
    matched = spark.createDataFrame([(1, "a"), (2, "z")], "id long, list string")
    assert sorted(map(tuple, members(rows, matched, store.prepared(), "id").collect())) == [(1, "a"), (2, "z")]


def test_a_name_twice_changes_nothing(spark, lists, tmp_path):
    store, good = ListStore(spark, str(tmp_path / "lists")), lists[0]
    store.upsert(good)
    with pytest.raises(ValueError, match="2 times"):
        store.upsert(good.unionByName(good))
    assert latest(spark, store.table.root).number == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "x long")
    table.replace(spark.range(3).toDF("x"))
    table.replace(spark.range(5).toDF("x"), base=1)
    with pytest.raises(Conflict):
        table.replace(spark.range(9).toDF("x"), base=1)
    assert table.read().count() == 5
    assert len(table.vacuum()) == 2 and table.read().count() == 5


def test_half_a_marker_is_none(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "x long")
    table.replace(spark.range(3).toDF("x"))
    (tmp_path / "t" / MARKERS / "000000002").write_text("data/elsewhere\n")
    assert table.read().count() == 3
    with pytest.raises(Conflict):
        publish(spark, table.root, 2, "data/x")


def parts(tmp_path):
    return {d: sorted(os.listdir(tmp_path / "cat" / "data" / d)) for d in os.listdir(tmp_path / "cat" / "data") if d.startswith("file=")}


def test_only_changed_books_are_written(spark, tmp_path):
    path = str(tmp_path / "cat")
    books = spark.createDataFrame([("a", "Book A"), ("b/1", "Book B"), ("none", "Empty")], "shorthand string, full_name string")
    rows = spark.createDataFrame([(i, "ab"[i % 2] if i % 2 == 0 else "b/1", None if i % 3 else "x") for i in range(40)] + [(99, "unknown", "x")], "id long, source string, note string").repartition(5)
    first = write_snapshot(rows, books, path)
    assert {(r.shorthand, r.n_rows, r.written) for r in first.collect()} == {("a", 20, True), ("b/1", 20, True), ("none", 0, True)}
    files = parts(tmp_path)
    assert len(files) == 3 and all(sum(f.endswith(".parquet") and f.startswith("part") for f in v) == 1 for v in files.values())
    assert write_snapshot(rows.repartition(2), books, path).where("written").count() == 0
    assert parts(tmp_path) == files
    changed = rows.where("source <> 'a' or id <> 4").unionByName(rows.where("source = 'a' and id = 4").withColumn("note", F.lit("new")))
    assert [r.shorthand for r in write_snapshot(changed, books, path).where("written").collect()] == ["a"]
    now = parts(tmp_path)
    assert all(now[k] == v for k, v in files.items()) and len(now) == 4
    got = read_snapshot(spark, path)
    assert got.exceptAll(changed.where("source <> 'unknown'")).count() == 0 and got.count() == 40
    one = read_snapshot(spark, path, ["a", "a"])
    assert one.count() == 20 and len(one.inputFiles()) == 1 and one.where("id = 4").first().note == "new"
    assert read_snapshot(spark, path, ["none"]).count() == 0 and read_snapshot(spark, path, []).count() == 0
    with pytest.raises(ValueError, match="no book"):
        read_snapshot(spark, path, ["zzz"])
    assert len(vacuum(spark, path)) == 1 and read_snapshot(spark, path).count() == 40
    assert {r.shorthand: len(r.tag) for r in current_index(spark, path).collect()} == {"a": 6, "b/1": 6, "none": 6}


def test_a_large_book_makes_several_files(spark, tmp_path):
    path = str(tmp_path / "cat")
    books = spark.createDataFrame([("a", "A"), ("b", "B")], "shorthand string, full_name string")
    rows = spark.range(1000).select("id", F.when(F.col("id") < 900, "a").otherwise("b").alias("source"))
    write_snapshot(rows, books, path, rows_per_file=200)
    counts = sorted(sum(f.startswith("part") for f in v) for v in parts(tmp_path).values())
    assert counts[0] == 1 and 2 <= counts[1] <= 5
    assert read_snapshot(spark, path).count() == 1000


def test_members_of_matched_classes(spark):
    """What is prepared is added where it isn't matched; the pairs are not made distinct."""
    rows = spark.createDataFrame([(1, "red"), (2, "blue"), (3, None), (4, "blue")], "id long, name string")
    lists = spark.createDataFrame([("a", [[["red"]]]), ("b", [[["red"]]]), ("c", None)], "list string, query array<array<array<string>>>")
    prepared = spark.createDataFrame([("a", "red"), ("a", "blue"), ("c", "red"), ("other", "blue")], "list string, name string")
    d = Dialect(source=None)
    want = sorted(map(tuple, members(rows, pc.percolate(rows, lists, d, "id"), prepared, "id").collect()))
    assert sorted(map(tuple, members(rows, pc.matched(rows, lists, d, "id"), prepared, "id").collect())) == want
    assert want == [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "other"), (4, "a"), (4, "other")]
