"""The search language, compiled to one boolean Column.

``;`` and ``,`` mean and, ``|`` means or: conjunctions of alternatives of
conjunctions. A leading ``!`` negates a term. A term holds if any rule of the
dialect that fits its first character holds; the name is always searched.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.cards import COST
from tomewright.functions.text import full_text, infix, same, sure, truthy

Query = list[list[list[str]]]

#: The saves that a term may name.
SAVES = ("will", "fortitude", "reflex")


def parse_query(text: str) -> Query:
    return [[[" ".join(z.split()) for z in y.split(",")] for y in x.split("|")] for x in text.split(";")]


@dataclass(frozen=True)
class Dialect:
    """Which columns the rules look at; ``prepared`` counts only where the rows have
    it. ``components`` are records with a display text, ``component_text`` is one
    text. ``cards`` is the order of cards (level and name if empty), by the rules of
    language where ``local``. ``comparers`` give sort keys for columns that don't
    sort by their own value."""

    name: str = "name"
    source: str | None = "source"
    level: str | None = None
    exact: tuple[str, ...] = ()
    exact_lists: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    materials: str | None = None
    components: str | None = None
    component_text: str | None = None
    hint: str | None = None
    save: str | None = None
    prepared: str | None = None
    priced: bool = False
    headers: tuple[str, ...] = ()
    cards: tuple[str, ...] = ()
    local: bool = False
    comparers: dict[str, Callable[[], list[Column]]] = field(default_factory=dict)


def _limits(term: str) -> list[int | None]:
    """Leading whole numbers of the parts after L; what isn't one never matches."""
    found = [re.match(r"\s*([+-]?\d+)", x) for x in term[1:].split("-")]
    return [int(m[1]) if m else None for m in found]


def compile_term(term: str, d: Dialect, df: DataFrame, strict_compat: bool = False) -> Column:
    if not term:
        return F.lit(True)
    kinds, rest = dict(df.dtypes), term[1:]
    rules = [infix(F.col(d.name), term)]
    rules += [same(F.col(c), term) for c in d.exact]
    rules += [sure(F.exists(F.col(c), lambda x: same(x, term))) for c in d.exact_lists]
    rules += [truthy(F.col(c), kinds[c]) for c in d.flags if c == term]
    if d.materials and term == "material":
        rules.append(truthy(F.col(d.materials), "string"))
    if d.prepared in kinds and term == "prepared":
        rules.append(sure(F.col(d.prepared)))
    if d.save and term.lower() in SAVES:
        rules.append(infix(F.col(d.save), term))
    first = term[0]
    if first == "$":
        if d.materials:
            rules.append(infix(F.col(d.materials), rest) & truthy(F.col(d.materials), "string"))
        if d.components:
            rules.append(sure(F.exists(F.col(d.components), lambda c: infix(c["display"], rest))))
        if d.component_text:
            rules.append(infix(F.col(d.component_text), rest) & truthy(F.col(d.component_text), "string"))
        if d.priced and d.materials and term == "$$":
            rules.append(sure(F.col(d.materials).rlike(COST)))
    elif first == ":" and d.source:
        rules.append(same(F.col(d.source), term if strict_compat else rest))
    elif first == "#" and d.hint:
        rules.append(infix(F.col(d.hint), rest) & truthy(F.col(d.hint), "string"))
    elif first == "\\":
        rules.append(same(F.col(d.name), rest))
    elif first == "L" and d.level:
        at, lim = F.col(d.level), _limits(term)
        if len(lim) == 1 and lim[0] is not None:
            rules.append(sure(at == lim[0]))
        elif len(lim) == 2 and None not in lim:
            rules.append(sure(at.between(*lim)))
    elif first == "/":
        rules.append(full_text(term, *[F.col(c) for c in d.texts]))
    return reduce(or_, rules)


def compile_query(query: str | Query, d: Dialect, df: DataFrame, strict_compat: bool = False) -> Column:
    """The predicate of a query over ``df``. Conjunctions that are always true
    are left out, so plain terms reach the optimizer alone."""
    parsed = parse_query(query) if isinstance(query, str) else query
    term = lambda z: ~compile_term(z[1:], d, df, strict_compat) if z.startswith("!") else compile_term(z, d, df, strict_compat)
    parts = []
    for x in parsed:
        ways = [[z for z in y if z] for y in x]
        if all(ways) and ways:
            parts.append(reduce(or_, (reduce(and_, map(term, y)) for y in ways)))
        elif not x:
            parts.append(F.lit(False))
    return reduce(and_, parts, F.lit(True)) if parts else F.lit(True)


def search(df: DataFrame, query: str | Query, d: Dialect, strict_compat: bool = False) -> DataFrame:
    return df.where(compile_query(query, d, df, strict_compat))


def search_with_members(df: DataFrame, term: str, d: Dialect, members: DataFrame, key: str) -> DataFrame:
    """Rows that a single term finds by themselves, or whose ``key`` is among
    ``members``: for terms that look into a detail table, which is filtered there,
    so that details are never gathered into lists. Each row comes once."""
    held = members.select(key).distinct().withColumn("_held", F.lit(True))
    return df.join(held, key, "left").where(compile_term(term, d, df) | sure(F.col("_held"))).drop("_held")


def saved_queries(df: DataFrame, lists: dict[str, str | Query], d: Dialect) -> DataFrame:
    """A row of ``df`` for each saved query it matches, with its name in ``list``:
    all queries in one scan, no join."""
    hits = [F.when(compile_query(q, d, df), F.lit(name)) for name, q in lists.items()]
    return df.withColumn("list", F.explode(F.array_compact(F.array(*hits))))
