"""Sorting: keys, directions and ties.

Plain columns sort descending unless reversed, columns with a comparer of their
own ascending unless reversed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import in_language
from tomewright.plans.search import Dialect


def parse_sorting(text: str) -> tuple[str, bool]:
    """(key, reverse) of ``key`` or ``-key``."""
    return (text[1:], True) if text.startswith("-") else (text, False)


def _flip(key: Column, reverse: bool) -> Column:
    return key.desc() if reverse else key.asc()


def sort_order(sorting: str | tuple[str, bool] | None, d: Dialect, ties: list[Column], df: DataFrame) -> list[Column]:
    """Order columns; without a sorting, ascending by name. An unknown key is an
    error. ``ties`` keep equal rows in their former order."""
    key, reverse = parse_sorting(sorting) if isinstance(sorting, str) else sorting or (d.name, True)
    if key in d.comparers:
        return [*(_flip(k, reverse) for k in d.comparers[key]()), *ties]
    if key not in df.columns:
        raise ValueError(f"no column {key!r} to sort by")
    return [F.col(key).asc() if reverse else F.col(key).desc(), *ties]


def sorted_rows(df: DataFrame, sorting: str | None, d: Dialect, ties: list[Column]) -> DataFrame:
    return df.orderBy(*sort_order(sorting, d, ties, df))


def card_order(d: Dialect) -> list[Column]:
    """By the columns of the dialect's cards; else by level, where there is one, then name."""
    name = in_language(F.col(d.name)) if d.local else F.col(d.name)
    return [(name if c == d.name else F.col(c)).asc() for c in d.cards or (d.level, d.name) if c]
