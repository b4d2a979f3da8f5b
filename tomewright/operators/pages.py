"""Entry pages of a wiki: their top blocks in order, against a fixed layout.

A page is an array of blocks, so a page is read within its row. What doesn't keep
the layout is a reject with the first thing that is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.parsing import parse_components, parse_duration, parse_level, parse_paren
from tomewright.operators.rejects import routed

#: How an entry page begins and ends, and what its four lines are called.
OPENING, CLOSING = ["div", "p", "p", "p", "p"], "div"
LINES = ["casting time", "range", "components", "duration"]
CLASSES, UPCAST = "spell lists", "at higher levels"
#: A block and what it holds. Blocks of one tag don't hold each other.
BLOCK = r"(?s)<(div|p|table|ul|ol|h[1-6])(?:\s[^<>]*)?>(.*?)</\1>"


def plain(html: Column) -> Column:
    """Text without tags, white space squeezed; the common entities as characters."""
    text = F.regexp_replace(html, "<[^<>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def blocks(html: Column, content: str = "page-content") -> Column:
    """The top blocks of the element with the id ``content``, up to the end of the page:
    tag, inner markup, text and the block as it is."""
    inner = F.regexp_extract(html, rf'(?s)<div[^<>]*\sid="{content}"[^<>]*>(.*)</div>', 1)
    part = lambda i: F.regexp_extract_all(inner, F.lit(BLOCK), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("tag"), part(2).alias("inner"), part(0).alias("whole"))
    return F.transform(zipped, lambda b: F.struct(b["tag"].alias("tag"), b["inner"].alias("inner"), b["whole"].alias("whole"), plain(b["inner"]).alias("text")))


def _line(lines: Column, i: int) -> tuple[Column, Column]:
    """The label of a property line in its first mark, and the rest of the line."""
    line = F.get(lines, F.lit(i))
    label = F.regexp_extract(line, r"(?s)^\s*<(strong|b|em)>(.*?)</\1>", 2)
    return F.lower(plain(label)), plain(F.regexp_replace(line, r"(?s)^\s*<(strong|b|em)>.*?</\1>", ""))


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda b: b["whole"]), "\n")


def entry_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(entries, rejects with reason) of pages of the layout: source, level, four lines,
    description, perhaps a section for higher levels, classes, perhaps a table."""
    rows = pages.select(key, blocks(F.col(html)).alias("b")).withColumns({"n": F.size("b"), "tags": F.transform("b", lambda x: x["tag"])})
    at = lambda i: F.get("b", F.lit(i))
    lines = F.split(at(3)["inner"], r"(?i)<br\s*/?>", -1)
    rest = F.slice("b", 5, F.greatest(F.col("n") - 5, F.lit(0)))
    rows = rows.withColumns({"source": F.split(at(1)["text"], ":", 2), "level": parse_level(at(2)["text"]), "lines": lines, "rest": rest})
    last = F.element_at("rest", -1)
    has_table = (F.size("rest") > 0) & (F.when(F.size("rest") > 0, last["tag"]) == "table")
    rows = rows.withColumn("stat_block", F.when(has_table, last["whole"])).withColumn("rest", F.when(has_table, F.slice("rest", 1, F.size("rest") - 1)).otherwise(F.col("rest")))
    final = F.when(F.size("rest") > 0, F.element_at("rest", -1))
    listed = (final["tag"] == "p") & (F.lower(F.left(final["text"], F.lit(len(CLASSES)))) == CLASSES)
    rows = rows.withColumns({
        "listed": F.coalesce(listed, F.lit(False)),
        "classes": F.filter(F.split(F.substring(final["text"], F.lit(len(CLASSES) + 2), F.length(final["text"])), "[ ,]+"), lambda x: x != ""),
        "body": F.slice("rest", 1, F.greatest(F.size("rest") - 1, F.lit(0))),
    })
    higher = F.transform("body", lambda x: F.lower(F.left(x["text"], F.lit(len(UPCAST)))) == UPCAST)
    cut = F.coalesce(F.nullif(F.array_position(higher, True), F.lit(0)) - 1, F.size("body"))
    said = F.regexp_replace(F.get("higher", F.lit(0))["inner"], r"(?s)^\s*<(\w+)[^<>]*>.*?</\1>", "")
    rows = rows.withColumn("cut", cut.cast("int")).withColumns({"main": F.slice("body", 1, F.greatest("cut", F.lit(0))), "higher": F.slice("body", F.col("cut") + 1, F.size("body"))})
    marked = F.when(F.size("higher") > 0, F.get("higher", F.lit(0))["inner"].rlike(rf"(?is)^\s*<\w+[^<>]*>(?:\s|<[^<>]*>)*{UPCAST}"))
    upcast = F.when(F.size("higher") > 0, F.concat_ws("\n", F.concat(F.lit("<p>"), F.trim(said), F.lit("</p>")), F.nullif(_joined(F.slice("higher", 2, F.greatest(F.size("higher") - 1, F.lit(0)))), F.lit(""))))
    line = [_line(F.col("lines"), i) for i in range(len(LINES))]
    rows = rows.withColumns({"time": F.split(line[0][1], ",", 2), "reach": parse_paren(line[1][1]), "parts": parse_components(line[2][1]), "lasts": parse_duration(line[3][1])})
    checks = [
        ("bad page-content makeup", (F.slice("tags", 1, len(OPENING)) == F.array(*map(F.lit, OPENING))) & (F.element_at("tags", -1) == CLOSING) & (F.col("n") > len(OPENING))),
        ("bad source format", (F.trim(F.get("source", F.lit(0))) == "Source") & (F.size("source") == 2)),
        ("bad level", F.col("level.ok")),
        ("expected 4 lines", F.size("lines") == len(LINES)),
        *[(f"bad {label} format", (said_ == f"{label}:") & (value != "")) for label, (said_, value) in zip(LINES, line, strict=True)],
        ("bad range", F.col("reach.ok")), ("bad components", F.col("parts.ok")), ("bad duration", F.col("lasts.ok")),
        ("expected class list", F.col("listed")), ("bad upcast format", F.coalesce(marked, F.lit(True))), ("empty description", F.size("main") > 0),
    ]
    out = rows.select(
        key, "source", "n", "tags", "level", "lines", "reach", "parts", "lasts", "listed", "main", "higher", "classes", "stat_block", F.trim(F.get("time", F.lit(0))).alias("casting_time"),
        F.trim(F.get("time", F.lit(1))).alias("reaction"), upcast.alias("upcast"), _joined(F.col("main")).alias("description"),
    )
    good, bad = routed(out, checks)
    entries = good.select(
        key, F.trim(F.split(F.trim(F.get("source", F.lit(1))), "/")[0]).alias("book"), "level.level", "level.school", "level.ritual", "casting_time", "reaction", F.col("reach.before").alias("range"),
        "parts.verbal", "parts.somatic", "parts.materials", "lasts.concentration", "lasts.duration", "description", "upcast", "classes", "stat_block",
    )
    return entries, bad.select(key, "reason")
