"""The search language against a row-at-a-time model, and its edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tomewright.functions.text import camel_to_title, find_window, full_text, html_encode, infix_word, latex_plain, markdown_lines, natural_join, ordinal, same, split_by, tags_as_html
from tomewright.plans.dialects import ARCANE, LEVELLED, TRAITED
from tomewright.plans.search import Dialect, compile_query, parse_query, search
from tomewright.plans.sorting import card_order, parse_sorting, sort_order

D = Dialect(level="level", exact=("school",), flags=("ritual",), texts=("text",), materials="materials", priced=True, hint="hint")
ROWS = [
    ("Shield", "A", "abjuration", 1, True, "An éclair of force", "50 gp", None),
    ("shield of x", "A", "Abjuration", 2, None, None, "", "old"),
    ("ÉCLAIR", "B", "evocation", 9, False, "L3 (x) a.b*", "5 gp", "#1"),
    ("eclair", "B", None, None, None, "", None, None),
    ("Red!", "C", "illusion", 3, True, "word_ word1 wörd", "1,000 gp consumed", "new"),
]
COLS = "name string, source string, school string, level int, ritual boolean, text string, materials string, hint string"


def model(term, r):
    """The rules one by one, as prose has them."""
    name, source, school, level, ritual, text, materials, hint = r
    low = lambda x: (x or "").lower()
    rest = term[1:]
    hits = [term.lower() in low(name), school is not None and len(school) == len(term) and low(school) == term.lower(), term == "ritual" and bool(ritual), term == "material" and bool(materials)]
    if term[:1] == "$":
        hits += [bool(materials) and rest.lower() in low(materials), term == "$$" and bool(re.search(r"[1-9][0-9,]+\s*gp", materials or "", re.I))]
    if term[:1] == ":":
        hits.append(low(source) == rest.lower())
    if term[:1] == "#":
        hits.append(bool(hint) and rest.lower() in low(hint))
    if term[:1] == "\\":
        hits.append(low(name) == rest.lower())
    if term[:1] == "L" and level is not None:
        found = [re.match(r"\s*([+-]?\d+)", x) for x in rest.split("-")]
        if all(found):
            limits = [int(m[1]) for m in found]
            hits.append(len(limits) == 1 and level == limits[0] or len(limits) == 2 and limits[0] <= level <= limits[1])
    if term[:2] == "//":
        hits.append(bool(text) and bool(re.search(rf"(^|[^A-Za-z0-9_]){re.escape(term[2:])}($|[^A-Za-z0-9_])", text, re.I)))
    elif term[:1] == "/":
        hits.append(bool(text) and rest.lower() in low(text))
    return any(hits)


def expected(query, r):
    one = lambda z: not model(z[1:], r) if z.startswith("!") else model(z, r)
    return all(any(all(one(z) for z in y) for y in x) for x in parse_query(query))


TERMS = ["", "!", "shield", "!shield", "L3", "L1-3", "L3-5-7", "L", "L6x", "\\eclair", "/force", "//word", "//word1", "$5", "$$", ":b", "#1", "ritual", "!ritual", "material", "abjuration", "a.b*", "(x)", "!!x", "é", "Red!"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, COLS)


@pytest.mark.parametrize("query", [*TERMS, ";", "a|", "a,b|c;d", "  shield   of "])
def test_terms(rows, query):
    got = sorted(r.name for r in search(rows, query, D).collect())
    assert got == sorted(r[0] for r in ROWS if expected(query, r))


def test_random_queries(rows):
    rng = random.Random(5)
    queries = [";".join("|".join(",".join(rng.choice(TERMS) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 2))) for _ in range(40)]
    flags = rows.select("name", *[compile_query(q, D, rows).alias(f"q{i}") for i, q in enumerate(queries)]).collect()
    by_name = {r[0]: r for r in ROWS}
    for f in flags:
        for i, q in enumerate(queries):
            assert f[f"q{i}"] == expected(q, by_name[f.name]), (q, f.name)


def test_negation_is_the_complement(rows):
    for term in TERMS:
        if term and not term.startswith("!"):
            assert search(rows, term, D).count() + search(rows, f"!{term}", D).count() == len(ROWS)


def test_parse():
    assert parse_query("a,b|c;d") == [[["a", "b"], ["c"]], [["d"]]]
    assert parse_query("") == [[[""]]]
    assert parse_sorting("-x") == ("x", True) and parse_sorting("x") == ("x", False)


def test_source_compat(rows):
    assert search(rows, ":A", D).count() == 2
    assert search(rows, ":A", D, strict_compat=True).count() == 0


def test_unknown_sort_key(rows):
    with pytest.raises(ValueError):
        sort_order("nothing", D, [], rows)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_texts(spark):
    v = lambda c: value(spark, c)
    assert v(markdown_lines(F.lit("# T\n---\n* a *b* c\n2. x\nplain __s__  \n\nno! \\*"))) == "<h1>T</h1><hr/><ul><li>a <em>b</em> c</li></ul><ul><li>x</li></ul><p>plain <strong>s</strong><br/></p><p>no! *</p>"
    assert v(latex_plain(F.lit("a \\textbf{b} % c\nd  e\\%"))) == "a b d e%"
    assert v(html_encode(F.lit("<é & 'x'>"))) == "&lt;&#233; &amp; &#39;x&#39;&gt;"
    assert [v(ordinal(F.lit(i))) for i in (1, 11, 22, 111)] == ["1st", "11th", "22nd", "111st"]
    assert v(natural_join(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b, and c"
    assert camel_to_title("castingTime") == "Casting Time"
    assert v(same(F.lit("ÉCLAIR"), "éclair")) and not v(same(F.lit("eclair"), "éclair"))
    assert v(infix_word(F.lit("x é y"), "x")) and not v(infix_word(F.lit("x_"), "x"))
    assert v(full_text("/x", F.lit(None).cast("string"), F.lit("aXb"))) and not v(full_text("x", F.lit("x")))


def test_dialects(spark):
    columns = "name string, source string, level int, school string, casting_time string, duration string, classes array<string>, verbal boolean, somatic boolean, ritual boolean, concentration boolean, upcast string, materials string, hint string, description string, stat_block string"
    rows = [
        ("Ward", "A", 2, "abjuration", "1 action", "1 hour", ["Cleric"], True, False, False, False, "more", "50 gp dust", "old", "A ward of light", None),
        ("Bolt", "B", 3, "evocation", "1 reaction", "1 round", ["Mage"], True, True, True, False, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, columns)
    names = lambda q: [r.name for r in search(df, q, LEVELLED).collect()]
    assert names("cleric") == names("L1-2") == names("$$") == names("#old") == names("/light") == names(":a") == names("upcast") == ["Ward"]
    assert names("ritual") == names("1 REACTION") == names("!material") == ["Bolt"]
    assert [r.name for r in df.orderBy(*sort_order("casting_time", LEVELLED, [F.col("name")], df)).collect()] == ["Bolt", "Ward"]
    other = spark.createDataFrame([("Hex", ["Curse"], ["occult"], "Will negates", 1)], "name string, tags array<string>, traditions array<string>, save string, level int")
    for c in ("range", "area", "duration", "casting_time", "description", "reaction", "summary", "components"):
        other = other.withColumn(c, F.lit(None).cast("string"))
    assert all(search(other, q, TRAITED).count() == 1 for q in ("curse", "OCCULT", "will", "L1", "\\hex")) and search(other, "reflex", TRAITED).count() == 0
    assert ARCANE.headers == ("power_level", "arcanum", "casting_time", "duration", "distance", "combat", "reaction")
    assert LEVELLED.headers == ("level", "school", "casting_time", "ritual", "concentration", "source") and TRAITED.headers == ("level", "range", "casting_time", "components")
    assert set(ARCANE.comparers) == {"power_level", "arcanum", "casting_time", "duration", "distance"} and set(TRAITED.comparers) == {"casting_time", "range", "components"}


def test_traited_entries_sort_and_match(spark):
    rows = [("Éa", 60, 0, "touch", "VS", True), ("ea", 6, 0, "Self", "V", False), ("Eb", 6, 30, "30 feet", "S", None), ("ex", 1, 0, "self", None, None), ("ez", 3, 5, "5 feet", "a long one", None)]
    df = spark.createDataFrame(rows, "name string, seconds int, feet int, range string, components string, prepared boolean")
    for c in ("area", "duration", "casting_time", "description", "reaction", "summary", "save"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    df = df.withColumns({"level": F.lit(1), "tags": F.array(F.lit("Öl")), "traditions": F.lit(None).cast("array<string>")})
    order = lambda key: [r.name for r in df.orderBy(*sort_order(key, TRAITED, [F.col("name")], df)).collect()]
    names = lambda q: {r.name for r in search(df, q, TRAITED).collect()}
    assert order("casting_time") == ["ex", "ez", "Eb", "ea", "Éa"]
    assert order("range") == ["ex", "ea", "Éa", "ez", "Eb"] and order("-range") == ["Eb", "ez", "Éa", "ea", "ex"]
    assert order("components") == ["ex", "Eb", "ea", "Éa", "ez"]
    assert [r.name for r in df.orderBy(*card_order(TRAITED)).collect()] == ["ea", "Éa", "Eb", "ex", "ez"]
    assert names("$v") == {"Éa", "ea"} and names("prepared") == {"Éa"} and names("$") == {"Éa", "ea", "Eb", "ez"}
    assert names("öl") == names("o\u0308l".replace("o\u0308", "ö")) == {r[0] for r in rows} and names("ol") == set()
    assert names("SELF") == {"ea", "ex"} and names("\\éA") == {"Éa"} and names("\\EA") == {"ea"}


def test_arcane_enums_sort(spark):
    df = spark.createDataFrame([("a", "Greater", "Wytch"), ("b", "Ritual", "General"), ("c", "Petty", "Charms"), ("d", "Generalist", "Divine"), ("e", "other", None)], "name string, power_level string, arcanum string")
    order = lambda key: [r.name for r in df.orderBy(*sort_order(key, ARCANE, [F.col("name")], df)).collect()]
    assert order("power_level") == ["e", "b", "c", "d", "a"] and order("arcanum") == ["e", "b", "c", "d", "a"]
    assert [r.name for r in df.orderBy(*card_order(ARCANE)).collect()] == ["a", "b", "c", "d", "e"]


def test_windows_groups_and_tags(spark):
    t = spark.createDataFrame([("x THEN then", ["a", "|", "|", "b", "|"], '<title level="1" x="2">a</title>')], "s string, l array<string>, h string")
    r = t.select(
        find_window(F.col("s"), [("#", "zzz", ""), ("#", "then", "")]).alias("first"), find_window(F.col("s"), [("", "th.n", "#")]).alias("second"), find_window(F.col("s"), [("", "q", "")]).alias("none"),
        split_by(F.col("l"), lambda x: x == "|").alias("groups"), split_by(F.col("l"), lambda x: x == "|", no_empty=True).alias("full"), tags_as_html(F.col("h"))["ok"].alias("ok"),
    ).first()
    assert tuple(r["first"]) == (2, 4) and tuple(r.second) == (2, 4) and r.none is None and not r.ok
    assert r.groups == [["a"], [], ["b"]] and r.full == [["a"], ["|", "b"]]
