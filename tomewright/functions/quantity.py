"""Quantities in free text, as numbers to sort by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")

#: Seconds, with reaction before bonus action before action.
ACTION_UNITS = {
    "reaction": 1, "reactions": 1, "bonus action": 2, "bonus actions": 2, "action": 3, "actions": 3,
    "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
}

#: Seconds; a whole round is a little longer than a turn.
TURN_UNITS = {
    "acp": 1, "[s]": 1, "[turn]": 3, "[turns]": 3, "[round]": 3.001, "[rounds]": 3.001, "[min]": 60, "[h]": 3600, "[d]": 86400,
    "[w]": 604800, "[m]": 365.2425 * 86400 / 12,
}


def unit_map(units: dict[str, float]) -> Column:
    return F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(float(v)))])


def number(text: Column) -> Column:
    """What a whole trimmed text says as a decimal number, else null; empty is 0."""
    t = F.trim(text)
    ok = t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(t == "", F.lit(0.0)).when(ok, t.cast("double"))


def least_quantity(text: Column, units: dict[str, float]) -> Column:
    """The least of the valid alternatives ``<n> <unit>`` that ``or``, ``/`` and
    commas separate; null without one."""
    known = unit_map(units)
    flat = F.regexp_replace(text, r"\s", " ")
    alternatives = F.split(F.translate(F.regexp_replace(flat, " or ", ","), "/", ","), ",")

    def value(x: Column) -> Column:
        n = F.substring_index(F.trim(x), " ", 1)
        unit = F.lower(F.trim(F.substring(F.trim(x), F.length(n) + 1, F.length(x))))
        size = F.get(F.map_values(F.map_filter(known, lambda k, _: k == unit)), F.lit(0))
        return F.when(n.rlike("^[0-9]+$"), n.cast("double") * size)

    return F.array_min(F.transform(alternatives, value))


def null_div(a: Column, b: Column) -> Column:
    """Division with infinities and NaN for a zero divisor, null for a null."""
    by_zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(INFINITY)).otherwise(F.lit(-INFINITY))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def _fold(parts: Column, term, combine) -> Column:
    """First term, then ``combine`` with each of the rest; null spreads. Every
    part is evaluated once."""
    start = F.struct(F.lit(False).alias("begun"), F.lit(None).cast("double").alias("v"))
    step = lambda acc, x: F.struct(F.lit(True).alias("begun"), F.when(acc["begun"], combine(acc["v"], x)).otherwise(x).alias("v"))
    return F.aggregate(F.transform(parts, term), start, step, lambda acc: acc["v"])


#: How texts write the sign of a product, in any case.
TIMES = ["·", "&#183;", "&#xB7;", "&centerdot;"]


def computed(text: Column) -> Column:
    """The value of sums, differences, products (middle dots) and quotients of
    numbers; a word without digits counts 6; null where a part is neither."""

    def leaf(x: Column) -> Column:
        return F.when(x.rlike("[0-9]"), number(x)).when(x.rlike("[A-Za-z0-9_]"), F.lit(6.0))

    quotient = lambda x: _fold(F.split(x, "/"), leaf, null_div)
    product = lambda x: _fold(F.split(x, "(?i)" + "|".join(TIMES)), quotient, lambda a, b: a * b)
    difference = lambda x: _fold(F.split(x, "-"), product, lambda a, b: a - b)
    return _fold(F.split(F.regexp_replace(text, "<[^>]*>", ""), r"\+"), difference, lambda a, b: a + b)


#: Seconds of words for durations, and words that say none.
LASTING = {"instant": 0.1, "eternal": INFINITY}
ETERNAL_UNTIL = 1e20
UNSAID = ["varies", "see effect"]
#: Metres of words for distances, and of their units.
REACHING = {"touch": 0.1, "any": INFINITY, "vision": 5000.0}
REACH_UNITS = {"[m]": 1, "[km]": 1000}


def _looked_up(key: Column, values: dict[str, float]) -> Column:
    return F.get(F.map_values(F.map_filter(unit_map(values), lambda k, _: k == key)), F.lit(0))


def _with_unit(text: Column) -> tuple[Column, Column]:
    """What stands before the last unit in brackets and white space, and the unit;
    null where the text does not end so."""
    inner = F.substring_index(text, "[", -1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(inner) - 1)
    ok = text.contains("[") & inner.endswith("]") & head.rlike(r"\s$")
    return F.when(ok, head), F.when(ok, F.concat(F.lit("["), inner))


def duration(text: Column) -> Column:
    """Seconds of ``<computation> [unit]``; keywords instant and eternal, and
    eternal with a condition in brackets."""
    low = F.regexp_replace(F.lower(text), r"\s+", " ")
    head, unit = _with_unit(text)
    value = computed(head)
    condition = F.ltrim(F.substring(low, len("eternal") + 1, 1_000_000))
    until = low.startswith("eternal") & condition.startswith("(") & condition.endswith(")")
    return F.when(until, ETERNAL_UNTIL).when(low.isin(list(LASTING)), _looked_up(low, LASTING)).when(~low.isin(UNSAID) & ~F.isnan(value), value * _looked_up(unit, TURN_UNITS))


def _without_word(text: Column, words: list[str]) -> Column:
    """``text`` without one of the words at its end."""
    last = F.substring_index(text, " ", -1)
    return F.when(F.lower(last).isin(words), F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(last)))).otherwise(text)


def distance(text: Column) -> Column:
    """Metres of ``<computation> [m]`` or ``[km]``, also with radius or diameter
    after it or as a maximum of vision; keywords touch, any and vision."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    bare = _without_word(flat, ["radius", "diameter"])
    low = F.lower(bare)
    # "vision (maximum x)": what is in the brackets, less the word
    inner = F.trim(F.substring(bare, F.locate("(", bare) + 1, F.length(bare) - F.locate("(", bare) - 1))
    limited = low.startswith("vision") & (F.trim(F.substring(low, F.lit(7), F.locate("(", low) - 7)) == "") & low.endswith(")") & F.lower(inner).startswith("maximum ")
    head, unit = _with_unit(F.trim(F.when(limited, F.substring(inner, len("maximum ") + 1, 1_000_000)).otherwise(bare)))
    return F.when(F.lower(text).isin(list(REACHING)), _looked_up(F.lower(text), REACHING)).otherwise(computed(F.trim(head)) * _looked_up(unit, REACH_UNITS))


def sort_columns(value: str, text: str) -> dict[str, Column]:
    """Keys to be sorted upwards, nulls last: valid values first by size, then the
    rest by text. Zero, NaN and null are not valid."""
    v = F.col(value)
    invalid = F.coalesce((v == 0) | F.isnan(v), F.lit(True))
    return {"_invalid": invalid, "_value": F.when(~invalid, v), "_text": F.when(invalid, F.col(text))}


def ranks(order: list[str], value: Column) -> Column:
    """The place of a value in a fixed list, from 0."""
    return reduce(lambda acc, kv: acc.when(value == kv[1], kv[0]), enumerate(order[1:], 1), F.when(value == order[0], 0)).cast("int")
