"""Entries as readable cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import ordinal, sure

#: A cost of ten gold or more, and how texts say that materials are used up.
COST = r"(?i)([1-9][0-9,]+\s*gp)"
USED_UP = "(?i)(which the spell consumes|consumed by the spell)$"


def costs(materials: Column) -> Column:
    """The high costs that materials name."""
    return F.regexp_extract_all(materials, F.lit(COST), F.lit(1))


def used_up(materials: Column) -> Column:
    return materials.rlike(USED_UP)


def cells(df: DataFrame, headers: list[str]) -> list[Column]:
    """Columns as cells of a table: flags as Yes or No, lists joined by commas,
    nothing for a null."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        at = F.col(f"`{c}`")
        if kinds[c] == "boolean":
            return F.when(F.coalesce(at, F.lit(False)), "Yes").otherwise("No").alias(c)
        text = F.array_join(at, ",") if kinds[c].startswith("array") else at.cast("string")
        return F.coalesce(text, F.lit("")).alias(c)

    return [cell(c) for c in headers]


def level_line(level: Column, school: Column) -> Column:
    """``3rd-level illusion``, or ``illusion Cantrip`` at level 0."""
    return F.when(level == 0, F.concat(school, F.lit(" Cantrip"))).otherwise(F.concat(ordinal(level), F.lit("-level "), school))


def component_line(verbal: Column, somatic: Column, materials: Column) -> Column:
    """V, S and M, the materials in parentheses with high costs in bold; M is bold
    too where they cost, and starred where they are then used up."""
    has = sure(materials != "")
    dear = materials.rlike(COST)
    used = used_up(materials)
    letter = F.when(dear & used, "<b>M*</b>").when(dear, "<b>M</b>").otherwise("M")
    shown = F.concat(letter, F.lit(" ("), F.regexp_replace(materials, COST, "<b>$1</b>"), F.lit(")"))
    return F.array_join(F.array_compact(F.array(F.when(sure(verbal), "V"), F.when(sure(somatic), "S"), F.when(has, shown))), ", ")


def origin_line(book: Column, hint: Column) -> Column:
    return F.when(hint.isNotNull(), F.concat(book, F.lit(" ("), hint, F.lit(")"))).otherwise(book)


def duration_line(concentration: Column, duration: Column) -> Column:
    return F.concat(F.when(sure(concentration), "Concentration, up to ").otherwise(""), duration)


def card(fields: list[tuple[str, Column]], body: Column) -> Column:
    """A table of the fields that are set, then the body."""
    rows = [F.when(sure(v != ""), F.concat(F.lit(f"<tr><th>{k}</th><td>"), v, F.lit("</td></tr>"))) for k, v in fields]
    return F.concat(F.lit("<table>"), F.array_join(F.array_compact(F.array(*rows)), ""), F.lit("</table><p>"), F.coalesce(body, F.lit("")), F.lit("</p>"))


def properties(lines: list[list[tuple[str, Column]]], between: str = "; ", after: str = "<br/>") -> Column:
    """Lines of ``<b>name</b> value`` pairs; what isn't set is left out, and so is a
    line of which nothing is."""
    pair = lambda k, v: F.when(sure(v != ""), F.concat(F.lit(f"<b>{k}</b> "), v))
    each = [F.array_join(F.array_compact(F.array(*[pair(k, v) for k, v in line])), between) for line in lines]
    return F.array_join(F.filter(F.array(*each), lambda x: x != ""), after)


def marked_component(c: Column) -> Column:
    """The display of a component with the first letter of its tag, unless that is
    MISC, and C or U where it is consumed or used."""
    letter = F.when(c["tag"] != "MISC", F.concat(F.lit("<sup>"), F.left(c["tag"], F.lit(1)), F.lit("</sup>"))).otherwise("")
    flag = lambda x, mark: F.when(sure(c[x]), F.lit(f"<sup>{mark}</sup>")).otherwise("")
    return F.concat(c["display"], letter, flag("consumed", "C"), flag("used", "U"))


def priced_components(components: Column, shown_price) -> Column:
    """Components joined by commas. Those of the tag MISC that have a price show it,
    by ``shown_price``, as a link where a reference is known."""

    def one(c: Column) -> Column:
        price = F.concat(F.lit(" ("), shown_price(c["price"]), F.lit(")"))
        linked = F.when(sure(c["reference"] != ""), F.concat(F.lit('<a href="'), c["reference"], F.lit('">'), price, F.lit("</a>"))).otherwise(price)
        shown = F.when((c["tag"] == "MISC") & c["price"].isNotNull(), F.concat(F.lit('<b class="price">'), linked, F.lit("</b>"))).otherwise("")
        return F.concat(marked_component(c), shown)

    return F.array_join(F.transform(components, one), ", ")


def arcane_fields(difficulty: dict[str, int], components: Column) -> list[tuple[str, Column]]:
    """What a card of an arcane entry says, from columns of that dialect: a level with
    its difficulty, and marks for combat and reactions."""
    col, mark = F.col, lambda c, m: F.when(sure(F.col(c)), m).otherwise("")
    dc = F.coalesce(*[F.when(col("power_level") == k, F.lit(v)) for k, v in difficulty.items()], F.lit(0))
    level = F.concat(col("power_level"), F.when(dc > 0, F.concat(F.lit(" (DV "), dc.cast("string"), F.lit(")"))).otherwise(""), mark("combat", " (C)"))
    return [
        ("Arcanum", col("arcanum")), ("Power Level", level), ("Casting Time", F.concat(col("casting_time"), mark("reaction", " (R)"))),
        ("Distance", col("distance")), ("Duration", col("duration")), ("Components", components),
    ]


def arcane_body(effect: Column, success: Column, failure: Column, extra: Column) -> Column:
    """The effect, what great success and failure do, and a last part where there is one."""
    part = lambda k, v: F.concat(F.lit(f"<p><b>{k}: </b>"), v, F.lit("</p>"))
    last = F.when(sure(extra != ""), F.concat(F.lit('<hr/><div class="extra">'), extra, F.lit("</div>"))).otherwise("")
    return F.concat(part("Effect", effect), part("Succeeding &geq; 10", success), part("Failing &leq; 5", failure), last)


#: Casting times that have a picture.
PICTURES = ["Free Action", "Two Actions", "Three Actions", "Single Action", "Reaction"]


def casting_picture(time: Column) -> Column:
    """The picture of a casting time, or of both ends of ``x to y``; null where one
    has none."""
    ends = F.split(time, " to ", -1)
    shown = F.transform(ends, lambda x: F.when(x.isin(PICTURES), F.concat(F.lit('<img src="/img/'), x, F.lit('.png"/>'))))
    return F.when((F.size(ends) <= 2) & ~F.exists(shown, lambda x: x.isNull()), F.array_join(shown, " to "))


def traited_lines(traditions: bool = True) -> list[list[tuple[str, Column]]]:
    """The property lines of a traited entry, from columns of that dialect: with or
    without its traditions, and a cantrip by its tag."""
    col = F.col
    cantrip = sure(F.exists("tags", lambda x: F.lower(x) == "cantrip"))
    first = [[("Traditions", F.array_join("traditions", ", "))]] if traditions else []
    return [
        *first, [("Level", F.concat(F.when(cantrip, "Cantrip ").otherwise("Spell "), col("level").cast("string")))], [("Cast", F.coalesce(F.concat(casting_picture(col("casting_time")), F.lit(" "), col("components")), F.concat(col("casting_time"), F.lit("; "), col("components"))))],
        [("Trigger", col("reaction"))], [("Range", col("range")), ("Area", col("area")), ("Targets", col("targets"))], [("Save", col("save")), ("Duration", col("duration"))],
    ]


def tag_list(tags: Column) -> Column:
    return F.concat(F.lit('<div class="tag-list">'), F.array_join(F.transform(tags, lambda x: F.concat(F.lit('<div class="tag-box">'), x, F.lit("</div>"))), ""), F.lit("</div>"))


def page_origin(book: Column, page: Column) -> Column:
    return F.concat(book, F.lit(" (pg. "), page.cast("string"), F.lit(")"))
