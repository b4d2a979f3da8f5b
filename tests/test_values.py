"""Quantities, prices, parsers and files: golden cases."""

import math

import pytest
from pyspark.sql import functions as F

from tomewright.functions import text
from tomewright.functions.money import format_price, format_sum
from tomewright.functions.parsing import component, gcd, parse_components, parse_level, parse_price, split_components
from tomewright.functions.quantity import ACTION_UNITS, computed, distance, duration, least_quantity
from tomewright.operators.lists import merged
from tomewright.operators.ranking import ranked
from tomewright.sources.catalogue import default_sources, list_or_one, page_entries, read
from tomewright.sources.sink import index_json, manifest


def values(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_computed(spark):
    assert values(spark, computed, ["2+3·4-6/2", "Wis · 10", "2d6", "-5", "1/0", "?", "<b>3</b>", "2 &#183; 3", None]) == [11, 60, None, None, math.inf, None, 3, 6, None]


def test_durations(spark):
    got = values(spark, duration, ["Instant", "Eternal", "eternal (until x)", "varies", "see  effect", "3 [min]", "2d6 [h]", "1 [M]", "1 [m]", "nothing", "2 [rounds]"])
    assert got[:2] == [0.1, math.inf] and got[2:6] == [1e20, None, None, 180] and got[6:8] == [None, None] and round(got[8]) == 2629746 and got[9] is None and got[10] == 6.002


def test_distances(spark):
    got = values(spark, distance, ["Touch", "any", "Vision", "Vision (maximum 50 [m])", "3 [km] radius", "0 [m]", "5 feet", "vision (maximum 2 [km]) diameter"])
    assert got == [0.1, math.inf, 5000, 50, 3000, 0, None, 2000]


def test_quantities(spark):
    f = lambda t: least_quantity(t, ACTION_UNITS)
    assert values(spark, f, ["1 action", "1 Reaction, 2 hours", "1 action or 10 minutes", "special", ""]) == [3, 1, 3, None, None]


def test_prices(spark):
    rows = spark.createDataFrame([(0.0, 0), (36.0, 0), (432.0, 1), (469.5, 0), (0.0, 2)], "c double, n int")
    assert [r.p for r in rows.select(format_price(F.col("c")).alias("p")).collect()] == ["0Ⓒ", "1Ⓢ", "1Ⓖ", "1Ⓖ1Ⓢ1.5Ⓒ", "0Ⓒ"]
    assert [r.p for r in rows.select(format_sum(F.col("c"), F.col("n")).alias("p")).collect()][-3:] == ["1Ⓖ+?", "1Ⓖ1Ⓢ1.5Ⓒ", "???"]
    assert values(spark, parse_price, [r"1\Au 2 \Ag", r"3\Cu", r"x\Cu", "3"]) == [504, 3, None, None]


def test_parsers(spark):
    assert [tuple(r) for r in values(spark, parse_level, ["evocation cantrip", "2nd-level Illusion (Ritual)", "x"])] == [(True, 0, "evocation", False), (True, 2, "illusion", True), (False, None, "", False)]
    assert [r.ok for r in values(spark, parse_components, ["V", "V, M (x)", "V, M", "V, V", "V (x)", "Q"])] == [True, True, False, False, False, False]
    assert [tuple(r) for r in values(spark, component, ["3 [g] of iron", "a rope", "12 nails", "silver (2 [ml])", "candles"])] == [(3, "g", "iron"), (1, "1", "rope"), (12, "1", "nails"), (2, "ml", "silver"), (1, "1", "candles")]
    assert values(spark, split_components, ["a and b,and c, , sand"]) == [["a", "b", "c", "sand"]]
    assert spark.range(1).select(gcd(F.lit(2**31 - 1), F.lit(12))).first()[0] == 1
    assert spark.range(1).select(gcd(F.lit(0), F.lit(12)), gcd(F.lit(-1), F.lit(2))).first()[:] == (12, None)


def test_ranks_over_many_ranges(spark):
    rows = spark.range(1000).withColumn("x", F.col("id") % 7)
    got = [(r.x, r.id) for r in ranked(rows, [F.col("x").desc(), F.col("id")]).orderBy("rank").collect()]
    assert got == sorted(got, key=lambda t: (-t[0], t[1])) and len(got) == 1000


def test_typed_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"name": "a", "level": 1}, null, {"name": "b", "level": null}]')
    assert sorted(r.name for r in read(spark, "copy", paths=str(tmp_path / "a.json"), schema="name string, level int").collect()) == ["a", "b"]
    (tmp_path / "b.json").write_text('[{"name": "a", "level": "x"}]')
    with pytest.raises(Exception):
        read(spark, "copy", paths=str(tmp_path / "b.json"), schema="name string, level int").collect()
    with pytest.raises(ValueError):
        read(spark, "copy", allowed={"text"}, paths="x", schema="a int")


def test_whole_texts(spark, tmp_path):
    (tmp_path / "a.tex").write_text("x\ny")
    assert [r.text for r in read(spark, "text", paths=str(tmp_path)).collect()] == ["x\ny"]


def test_lists(spark):
    assert values(spark, list_or_one, ['"a"', '["a", "b"]', "null"]) == [["a"], ["a", "b"], []]
    assert default_sources(["A", "B"], ["b"]) == ["B"] and default_sources(["A"], ["z"]) == ["A"] and default_sources(list("ABCD"), None) == ["A", "B", "C"]
    m = spark.createDataFrame([("k", ["a"]), ("k", ["b", "a"]), ("e", [])], "key string, values array<string>")
    assert {r.key: r["values"] for r in merged(m, m).collect()} == {"k": ["a", "b"], "e": []}


def test_links(spark):
    pages = spark.createDataFrame([(1, '<a href="/spell:x">Acid: Arrow </a><a href="/spell:y">Old (UA)</a><a href="/other">no</a>')], "page_id int, html string")
    assert [(r.entry, r.slug) for r in page_entries(pages, "/spell:").collect()] == [("Acid: Arrow", "acid--arrow")]


def test_manifest(spark):
    rows = spark.createDataFrame([("A", 1), ("A", 2), ("X", 3)], "source string, v int")
    books = spark.createDataFrame([("A", "Alpha"), ("B", "Beta")], "shorthand string, full_name string")
    m = manifest(rows, books)
    got = {r.shorthand: (r.n_rows, r.tag) for r in m.collect()}
    assert got["A"][0] == 2 and len(got["A"][1]) == 6 and got["B"] == (0, None)
    again = {r.shorthand: r.tag for r in manifest(rows.orderBy(F.col("v").desc()), books).collect()}
    assert again["A"] == got["A"][1]
    assert index_json(m, "g").first()[0].startswith('{"g":{"A":{"title":"Alpha"')


def test_first_separator_and_places(spark):
    rows = [(1, " a : b: c "), (2, "plain\t"), (3, ""), (4, None), (5, "::")]
    df = spark.createDataFrame(rows, "i int, s string").select("i", text.split_first(F.col("s"), ":").alias("x"))
    assert [(r.i, r.x.left, r.x.right) for r in df.collect()] == [(1, "a", "b: c"), (2, "plain", None), (3, "", None), (4, None, None), (5, "", ":")]
    rows = [(["b", None, "a", "b"],), ([],), (None,), (["c"],)]
    is_b = lambda x: x == "b"
    df = spark.createDataFrame(rows, "x array<string>").select(text.indices_where(F.col("x"), is_b), text.first_index(F.col("x"), is_b))
    assert [tuple(r) for r in df.collect()] == [([0, 3], 0), ([], -1), (None, None), ([], -1)]
