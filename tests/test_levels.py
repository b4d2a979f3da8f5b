r"""Levels of braces and environments, against a plain scan."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tomewright.functions import parsing as p
from tomewright.functions.levels import CUT, HIDDEN, base_level, split_at_base
from tomewright.functions.text import find_window


def tokens(text):
    return re.findall(r"\\begin(?![A-Za-z])|\\end(?![A-Za-z])|\\.|.", text, re.S)


def plain_split(text, is_separator, environments=False):
    """Parts between separator tokens at the base level, token by token."""
    parts, now, level, inside, closed = [], "", 0, 0, False
    for t in tokens(text):
        if t == "{":
            level += 1
        elif t == "}":
            level -= 1
            closed = closed or level < 0
        elif environments and t.startswith("\\begin"):
            inside += 1
        elif environments and t.startswith("\\end"):
            inside -= 1
        if is_separator(t) and level == 0 and inside <= 0 and not closed:
            parts.append(now)
            now = ""
        else:
            now += t
    return [*parts, now]


def test_split_at_base(spark):
    rng = random.Random(3)
    texts = ["", "a", ",", "a,b", "a{b,c}d,e", "{", "}", "a,b},c,d", "{{,},},x", r"a\{,b\},c", r"x\\{,},y", r"\begin{t}a,b\end{t},c", r"\beginning,x"]
    texts += ["".join(rng.choice(["a", ",", "{", "}", ",", r"\{", r"\begin", r"\end", " ", "é"]) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", split_at_base(F.col("t"), ",").alias("a"), split_at_base(F.col("t"), ",", environments=True).alias("b"), base_level(F.col("t")).alias("m")).collect()
    for r in rows:
        assert r.a == plain_split(r.t, lambda x: x == ","), r.t
        assert r.b == plain_split(r.t, lambda x: x == ",", environments=True), r.t
        assert len(r.m) == len(r.t) and all(x in (y, HIDDEN) for x, y in zip(r.m, r.t, strict=True))


def test_components_keep_groups_whole(spark):
    texts = {
        "a {x, y} thing": ["a {x, y} thing"], "a,b and {c and d}, and e": ["a", "b", "{c and d}", "e"], "sand and band": ["sand", "band"], ",, ,": [], "salt,and pepper": ["salt", "pepper"],
        "x and{y}": ["x", "{y}"], "band, brand": ["band", "brand"], "{a},{b}": ["{a}", "{b}"], "éandé and é": ["éandé", "é"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", p.split_components(F.col("t")).alias("x")).collect()} == texts


def test_windows_at_base(spark):
    df = spark.createDataFrame([("a {then} b then c",), ("{x then y}",), ("a{b}then c",)], "t string")
    option = [("#", "then", "#")]
    got = [r[0] for r in df.select(find_window(base_level(F.col("t")), option, HIDDEN)).collect()]
    assert got[0].at == 11 and got[1] is None and got[2] is None
    assert [r[0].at for r in df.select(find_window(F.col("t"), option)).collect()] == [3, 3, 4]


@pytest.mark.parametrize("digits", ["1" * 10, "1" * 11, "9" * 40])
def test_long_numbers_are_rejects(spark, digits):
    def v(c):
        return spark.range(1).select(c.alias("x")).first()[0]

    small = len(digits) == 10
    assert v(p.parse_level(F.lit(f"{digits}th-level illusion")))["ok"] == small
    assert v(p.parse_amount(F.lit(f"{digits} kg")))["ok"] == small and v(p.parse_amount(F.lit(f"{digits} kg")))["number"] == (1111111111 if small else None)
    assert (v(p.parse_price(F.lit(f"{digits} \\Au"))) is not None) == (len(digits) < 40)
    assert v(p.component(F.lit(f"{digits} [kg] of rope")))["number"] == (1111111111 if small else None)
    assert v(p.component(F.lit(f"rope ({digits} [m])")))["name"] == "rope"
    assert v(p.parse_price(F.lit("9223372036854775807 \\Ag"))) is None


def test_plain_separators_need_no_fold(spark):
    """Texts whose groups are closed and shallow are cut without the fold, others by it; both agree."""
    rng = random.Random(4)
    bits = ["a", "&", r"\&", r"\\", "{", "}", r"\{", r"\}", r"\begin{x}", r"\end{x}", "{b & c}", r"{d {e \\ f} &}", " ", CUT, "\\", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(2000)] + ["{a}" * 4000 + "&x", "{" + "{a}" * 60 + "}&x"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").repartition(4)
    for separator in (r"(?<!\\)&", r"\\\\"):
        for environments in (True, False):
            ways = [split_at_base(F.col("t"), separator, environments, looks).alias(n) for n, looks in (("a", True), ("b", False))]
            assert rows.select("t", *ways).where("not (a <=> b)").collect() == []


def test_a_text_of_many_groups_takes_time_by_its_length(spark):
    start = time.monotonic()
    text = F.concat(F.lit("&"), F.repeat(F.lit("{a} & "), 6000))
    assert spark.range(1).select(F.size(split_at_base(text, "&")).alias("n")).first().n == 6002
    assert time.monotonic() - start < 20
