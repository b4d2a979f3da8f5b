"""The data source of stored answers, its filters, and records with their rejects."""

import json

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

from tomewright.sources.hits import AnswerReader, Kept, hit_rows, hits_of_book, holds_phrase, short_answers, stored_hits


def record(name, book="First Book", **more):
    return {"_source": {"name": name, "category": "spell", "primary_source": book, "primary_source_raw": f"{book} pg. 12", "markdown": f"head --- about {name}", "level": 1, **more}}


@pytest.fixture
def answers(tmp_path):
    one = [record("a", tradition=["Arcane", " Occult "], component=["V", "S"]), record("b", "First Book 2"), record("c", category="item"), record("d", remaster_id="x"), None]
    two = [record("e", "first book"), record("f", tradition=["arcane"]), record("g", primary_source_raw="First Book"), record("h", markdown="no rule"), record(None), record("i", legacy_id="y", range_raw="30 feet")]
    lines = [json.dumps({"hits": {"total": {"value": n}, "hits": h}}) for n, h in ((5, one), (9, two))]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0.json").write_text(lines[0] + "\n\n")
    (tmp_path / "x" / "part-1.json").write_text(lines[1])
    (tmp_path / "x" / "_SUCCESS").write_text("")
    return str(tmp_path / "x")


def test_all_hits_and_short_answers(spark, answers):
    hits = stored_hits(spark, f"file:{answers}")
    assert hits.count() == 11 and hits.where("is_null").count() == 1
    assert [(r.total, r.n_hits) for r in short_answers(hits).collect()] == [(9, 6)]


def test_filters_reach_the_reader(spark, answers):
    rows = hits_of_book(spark, answers, "First Book")
    assert sorted(r.name or "" for r in rows.collect()) == ["", "a", "e", "f", "g", "h", "i"]
    assert stored_hits(spark, answers, "first BOOK").where("category = 'spell'").count() == 9
    assert stored_hits(spark, answers).where("primary_source = 'First Book'").count() == 8
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "primary_source" in plan.split("Filter", 1)[-1] and "category = spell" not in plan and "isnull(remaster_id" not in plan
    assert sorted(r.name or "" for r in hits_of_book(spark, answers, "First Book", legacy=True).collect()) == ["", "a", "d", "e", "f", "g", "h"]


def test_what_comes_back_to_spark():
    reader = AnswerReader("x")
    filters = [EqualTo(("primary_source",), "First Book"), EqualTo(("category",), "spell"), IsNull(("remaster_id",)), GreaterThan(("level",), 2)]
    assert list(reader.pushFilters(filters)) == [filters[0], filters[3]]
    assert reader.kept == Kept(("First Book",), ("spell",), ("remaster_id",))
    assert holds_phrase("The First  book 2", "first Book") and not holds_phrase("First's Book", "First Book") and not holds_phrase(None, "x")


def test_records_and_rejects(spark, answers):
    good, bad = hit_rows(hits_of_book(spark, answers, "First Book"), "PC")
    rows = {r.name: r for r in good.collect()}
    assert set(rows) == {"a", "e", "i"} and rows["a"].traditions == ["Arcane", "Occult"] and rows["a"].components == "V, S" and rows["a"].page == 12
    assert rows["a"].description.strip() == "about a" and rows["i"].range == "30 feet" and rows["a"].range == ""
    assert {(r.name, r.reason) for r in bad.collect()} == {
        ("f", "Invalid tradition: arcane"), ("g", "Invalid primary source: First Book"), ("h", "no description"), (None, "no name"),
    }
    everything, lost = hit_rows(stored_hits(spark, answers), "PC")
    assert everything.count() + lost.count() == 11 and lost.where("reason = 'null entry'").count() == 1
