"""Prices in three coins, and prices that are partly unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Silver for a gold coin, copper for a silver coin.
SILVER, COPPER = 12, 36


def format_price(copper: Column) -> Column:
    """Gold, silver and copper with their signs; parts of zero are left out, but
    nothing at all is 0 copper. Copper keeps one decimal unless it is .0."""
    c = copper.cast("double")
    gold, rest = F.floor(c / (SILVER * COPPER)), c % (SILVER * COPPER)
    rest = F.when(c >= SILVER * COPPER, rest).otherwise(c)
    silver = F.floor(rest / COPPER)
    small = F.when(rest >= COPPER, rest % COPPER).otherwise(rest)
    digits = F.replace(F.format_string("%.1f", small), F.lit(".0"), F.lit(""))
    return F.concat(
        F.when(c >= SILVER * COPPER, F.concat(gold.cast("string"), F.lit("Ⓖ"))).otherwise(""),
        F.when(rest >= COPPER, F.concat(silver.cast("string"), F.lit("Ⓢ"))).otherwise(""),
        F.when((small > 0) | (c == 0), F.concat(digits, F.lit("Ⓒ"))).otherwise(""),
    )


def format_sum(value: Column, n_unknown: Column) -> Column:
    """A sum of which parts may be unknown."""
    return F.when((n_unknown > 0) & (value == 0), "???").when(n_unknown > 0, F.concat(format_price(value), F.lit("+?"))).otherwise(format_price(value))


def scaled(value: Column, unknown: Column, by: Column) -> tuple[Column, Column]:
    """``by`` times a price; nothing, also of the unknown parts, at zero."""
    return F.when(by == 0, 0.0).otherwise(value * by), F.when(by == 0, F.array().cast("array<string>")).otherwise(unknown)
