r"""Material tables: rows and cells of tables in documents, and what they define.

A row holds cells between ``&`` and stands between ``\\``, both at its base level.
Macros in a row name materials, packet sizes, other units, prices, variants and
rules. A declaration of variants holds for the rows after it in the same table
until the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.levels import split_at_base
from tomewright.functions.parsing import parse_amount, parse_price
from tomewright.functions.text import latex_plain
from tomewright.operators.rejects import routed
from tomewright.operators.shared import written

#: An argument in braces, which may hold groups two deep.
ARGUMENT = r"\s*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"


def _found(text: Column, name: str, arguments: int, i: int) -> Column:
    """Argument ``i`` of each use of a macro; only texts that hold its name are searched."""
    pattern = rf"\\{name}(?![A-Za-z])\s*\*?" + ARGUMENT * arguments
    none = F.array().cast("array<string>")
    return F.when(~text.contains(f"\\{name}"), none).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(i)))


def macro(text: Column, name: str, arguments: int = 1) -> Column:
    """An array for each use of a macro, with or without a star: its arguments."""
    found = [_found(text, name, arguments, i + 1) for i in range(arguments)]
    return F.transform(F.arrays_zip(*[x.alias(f"a{i}") for i, x in enumerate(found)]), lambda z: F.array(*[z[f"a{i}"] for i in range(arguments)]))


def once(text: Column, name: str) -> Column:
    """The argument of a macro's first use; null where it isn't used."""
    return F.get(_found(text, name, 1, 1), F.lit(0))


def table_rows(tables: DataFrame, body: str = "body") -> DataFrame:
    """A row for each row of each table, with its place, text and cells; written, as
    what reads them looks at the cells many times."""
    rows = tables.select("*", F.posexplode(split_at_base(F.col(body), r"\\\\", environments=True, looks_at_braces=False)).alias("row", "text")).drop(body)
    return written(rows.where(F.trim("text") != "").withColumn("cells", split_at_base(F.col("text"), r"(?<!\\)&", environments=True, looks_at_braces=False)))


def _bare(text: Column) -> Column:
    """Plain text; line breaks inside a cell are spaces."""
    return F.trim(latex_plain(F.regexp_replace(text, r"\\\\", " ")))


def read_rows(rows: DataFrame, table: str = "table_id") -> DataFrame:
    """``rows`` with what their macros say: names, amounts, prices, variants, and the
    variants declared before them in their table. Carrying takes a window by table; a
    table is part of one document."""
    t = F.col("text")
    names = _found(t, "grMaterial", 1, 1)
    declared = once(t, "grDeclareVariants")
    split = lambda x: F.transform(F.split(x, "/"), lambda y: F.trim(y))
    earlier = Window.partitionBy(table).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    cell = lambda i: F.get("cells", F.lit(i))
    said = rows.withColumns({
        "n_names": F.size(names), "names": F.transform(F.when(F.size(names) > 0, names).otherwise(F.array(cell(0))), _bare),
        "unit": once(t, "grUnit"), "other": once(t, "grOtherUnit"), "variants": once(t, "grVariants"), "price": once(t, "grPrice"), "third": cell(2),
        "declared": F.transform(split(declared), _bare),
    })
    return said.withColumn("carried", F.last("declared", ignorenulls=True).over(earlier)).withColumns({
        "amount": parse_amount(F.coalesce("unit", F.lit(""))), "others": parse_amount(F.coalesce("other", F.lit(""))),
        "worth": parse_price(F.coalesce("price", "third")), "prices": F.transform(split(F.col("variants")), parse_price),
    })


def material_rows(rows: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that define materials, rejects with reason) of ``read_rows``; rows that
    define nothing are in neither. ``units`` has name and base_unit: another unit must
    count things, not measure them."""
    has = lambda c: F.col(c).isNotNull()
    known = units.select(F.col("name").alias("_unit"), F.col("base_unit").alias("_base"))
    met = rows.join(known, F.col("others.unit") == F.col("_unit"), "left").drop("_unit")
    plain = has("unit")
    checks = [
        ("incomplete material definition", (F.col("n_names") == 0) | plain | has("variants")),
        ("other unit without unit", plain | ~has("other")),
        ("unit and variants mixed", ~(plain & has("variants"))),
        ("price without unit", plain | ~has("price")),
        ("bad amount", ~plain | F.col("amount.ok")),
        ("bad other amount", ~has("other") | F.col("others.ok")),
        ("other unit is not dimensionless", ~has("other") | F.col("_base").isNull() | (F.col("_base") == "1")),
        ("bad price", ~plain | has("worth")),
        ("variants without declaration", ~has("variants") | has("carried")),
        ("number of variants differs", ~has("variants") | (F.size("prices") == F.size("carried"))),
        ("bad price of a variant", ~has("variants") | ~F.exists("prices", lambda x: x.isNull())),
        ("no name", F.forall("names", lambda x: F.coalesce(x != "", F.lit(False)))),
    ]
    nothing = ~plain & ~has("other") & ~has("variants") & ~has("price") & (F.col("n_names") == 0)
    return routed(met, checks, silent=nothing)


def materials_of(good: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., row, name, amount_number, amount_unit, copper): what good rows define,
    one or more for each of their names."""
    made = lambda name, n, unit, copper: F.struct(name.alias("name"), n.cast("long").alias("amount_number"), unit.alias("amount_unit"), copper.alias("copper"))
    times = F.col("amount.number").cast("long") * F.when(F.col("other").isNotNull(), F.col("others.number")).otherwise(1)
    simple = lambda n: F.array(made(n, times, F.col("amount.unit"), F.col("worth")))
    packed = lambda n: F.array(made(F.concat("others.unit", F.lit(" of "), n), F.col("others.number"), F.lit("1"), F.col("worth")))
    of_unit = lambda n: F.when(F.col("other").isNotNull(), F.concat(simple(n), packed(n))).otherwise(simple(n))
    of_variant = lambda n: F.zip_with("carried", "prices", lambda v, p: made(F.concat(v, F.lit(" "), n), F.lit(1), F.lit("1"), p))
    each = F.transform("names", lambda n: F.when(F.col("unit").isNotNull(), of_unit(n)).otherwise(of_variant(n)))
    return good.select(*keep, "row", F.explode(F.flatten(each)).alias("m")).select(*keep, "row", "m.*")


def rules_of(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., row, place, pattern, into, uses, uses_unit, makes, makes_unit) of the rules
    that table rows hold, for ``rules.extended_by``. Amounts that can't be read count
    as 0 of no unit, which that refuses; both blank make an alias."""
    found = rows.select(*keep, "row", F.posexplode(macro(F.col("text"), "grPost", 4)).alias("place", "r"))
    blank = (F.trim(F.col("r")[1]) == "") & (F.trim(F.col("r")[3]) == "")
    amount = lambda i: parse_amount(F.trim(F.col("r")[i]))
    number = lambda i: F.when(~blank, F.coalesce(amount(i)["number"], F.lit(0)))
    unit = lambda i: F.when(~blank, F.when(amount(i)["ok"], amount(i)["unit"]).otherwise("1"))
    return found.select(*keep, "row", "place", F.col("r")[0].alias("pattern"), F.col("r")[2].alias("into"), number(1).alias("uses"), unit(1).alias("uses_unit"), number(3).alias("makes"), unit(3).alias("makes_unit"))
