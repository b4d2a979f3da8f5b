r"""Braces and environments inside a text: what stands at its base level.

A text is cut before each brace (not one after a backslash) and, where environments
count, before ``\begin`` and ``\end``; a fold over the pieces carries the depth, so
that every piece knows its level. A closing brace without an opening one ends the
base level. Braces of one text should be few, hundreds rather than millions: the
fold copies what it has for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters for private use, which texts don't hold: a cut, and what is hidden.
CUT, HIDDEN = "\ue000", "\ue001"
#: Before a brace that no single backslash makes a plain character.
BRACE = r"(?=[{}])(?<!(?<!\\)\\)"
ENVIRONMENT = r"(?=\\(?:begin|end)(?![A-Za-z]))"


def _folded(text: Column, base: Callable[[Column], Column], nested: Callable[[Column], Column], environments: bool) -> Column:
    """``text`` with ``base`` applied to each stretch at the base level, together with
    the brace that follows it, and ``nested`` to what is deeper. A brace that opens
    a group counts as base level, its closing one as part of the group."""
    pieces = F.split(F.translate(text, CUT + HIDDEN, "  "), f"{BRACE}|{ENVIRONMENT}" if environments else BRACE)
    # each step reads what the one before has computed, once for a piece: names of
    # columns would be computed anew wherever they are used
    first = lambda q: F.when(F.left(q, F.lit(1)).isin("{", "}"), F.left(q, F.lit(1))).otherwise("")
    each = F.zip_with(pieces, F.slice(pieces, 2, 1 << 30), lambda p, q: F.struct(p.alias("p"), first(p).alias("brace"), F.coalesce(first(q), F.lit("")).alias("next")))
    each = F.filter(each, lambda x: x["p"].isNotNull())
    each = F.transform(each, lambda x: F.struct(*[x[c].alias(c) for c in ("p", "brace", "next")], F.when(x["brace"] == "}", 1).otherwise(0).alias("skip")))

    def looked_at(x: Column) -> Column:
        run = F.concat(F.substring(x["p"], x["skip"] + 1, F.length(x["p"])), x["next"])
        inside = F.when(x["p"].startswith("\\"), F.when(x["p"].rlike(r"^\\begin(?![A-Za-z])"), 1).when(x["p"].rlike(r"^\\end(?![A-Za-z])"), -1)) if environments else F.lit(None).cast("int")
        turn = F.when(x["brace"] == "{", 1).when(x["brace"] == "}", -1).otherwise(0)
        return F.struct(*[x[c].alias(c) for c in ("p", "brace", "next", "skip")], turn.alias("turn"), F.coalesce(inside, F.lit(0)).alias("inside"), base(run).alias("done"))

    each = F.transform(each, looked_at)
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("inside"), F.lit(False).alias("closed"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        p, level, inside = x["p"], s["level"] + x["turn"], s["inside"] + x["inside"]
        closed = s["closed"] | (level < 0)
        free = ~closed & (level == 0) & (inside <= 0)
        done = F.when(x["next"] != "", F.left(x["done"], F.length(x["done"]) - 1)).otherwise(x["done"])
        opens = (x["brace"] == "{") & (level == 1) & (inside <= 0) & ~closed
        deep = F.when(opens, F.concat(F.lit("{"), nested(F.substring(p, F.lit(2), F.length(p))))).otherwise(nested(p))
        out = F.when(free, F.concat(nested(F.left(p, x["skip"])), done)).otherwise(deep)
        return F.struct(level.alias("level"), inside.alias("inside"), closed.alias("closed"), F.concat(s["out"], out).alias("out"))

    return F.aggregate(each, start, step, lambda s: s["out"])


def base_level(text: Column, environments: bool = False) -> Column:
    """``text`` with each character that isn't at the base level hidden, so that
    places in it are places in the text."""
    return _folded(text, lambda run: run, lambda deep: F.repeat(F.lit(HIDDEN), F.length(deep)), environments)


#: A group that holds groups one deep, at most a few, so that matching is no deep recursion.
GROUP = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*){0,50}\}"


def split_at_base(text: Column, separator: str, environments: bool = False, looks_at_braces: bool = True) -> Column:
    """The parts of ``text`` between matches of the expression ``separator`` at the base
    level. A match doesn't reach over a group, but may look at the brace that
    follows. A text without one is a single part.

    A separator that neither is nor looks at a brace, and so says, is found without a
    fold in texts whose groups are closed and two deep at most: there a match outside of
    groups gets a cut, a group gets one too, which is taken away again."""
    cut = _folded(text, lambda run: F.regexp_replace(run, separator, CUT), lambda deep: deep, environments)
    if not looks_at_braces:
        odd = rf"[{CUT}{HIDDEN}]|(?<!\\)\\[{{}}]" + (r"|\\(?:begin|end)(?![A-Za-z])" if environments else "")
        simple = ~text.rlike(odd) & ~F.regexp_replace(text, GROUP, "").rlike("[{}]")
        marked = F.regexp_replace(text, f"({GROUP})|(?:{separator})", f"$1{CUT}")
        cut = F.when(simple, F.replace(marked, F.lit("}" + CUT), F.lit("}"))).otherwise(cut)
    return F.split(cut, CUT)
