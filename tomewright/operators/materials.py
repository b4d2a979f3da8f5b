"""Units, materials and the prices of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.parsing import gcd


def resolve_components(components: DataFrame, units: DataFrame, materials: DataFrame) -> DataFrame:
    """``components`` (number, unit, name, ...) with ``price`` and ``reference``.

    units: name, base_number, base_unit. materials: name, amount_number,
    amount_unit, copper, reference, unique by lower-case name. An unknown unit or
    material gives nulls; so does a unit that doesn't agree, which keeps the
    reference. A name without a unit that ends in s is also tried without it.
    Prices are whole copper times a whole number, then divided once.
    """
    u = units.select(F.col("name").alias("unit"), "base_number", "base_unit")
    m = materials.select(F.lower("name").alias("_key"), "amount_number", "amount_unit", "copper", "reference")
    both = components.join(u, "unit", "left").withColumn("_key", F.lower("name"))
    exact = both.join(m, "_key", "left").drop("_key")
    tried = (F.col("amount_number").isNull()) & (F.col("unit") == "1") & F.lower("name").endswith("s")
    shorter = F.when(tried, F.left(F.lower("name"), F.length("name") - 1))
    second = m.select(*[F.col(c).alias(f"_{c}2" if c != "_key" else "_key2") for c in m.columns])
    out = exact.withColumn("_key2", shorter).join(second, "_key2", "left")
    pick = lambda c: F.coalesce(c, f"_{c}2")
    agrees = pick("amount_unit") == F.col("base_unit")
    cost = F.col("number").cast("long") * F.col("base_number") * pick("copper").cast("long")
    price = F.when(agrees, cost.cast("double") / pick("amount_number"))
    known = F.col("base_unit").isNotNull()
    return out.select(*components.columns, price.alias("price"), F.when(known, pick("reference")).alias("reference"))


def normalized(amounts: DataFrame, units: DataFrame) -> DataFrame:
    """``amounts`` (number, unit, ...) in base units; null for unknown units."""
    u = units.select(F.col("name").alias("unit"), "base_number", "base_unit")
    return amounts.join(u, "unit", "left").withColumn("base_amount", F.col("number").cast("long") * F.col("base_number")).drop("base_number")


def glob_capture(name: Column, pattern: str) -> Column:
    """What the star of ``pattern`` (at most one) takes of ``name``, ignoring
    case; empty for a pattern without one; null where it doesn't match."""
    parts = pattern.split("*")
    if len(parts) > 2:
        raise ValueError(f"more than one * in {pattern!r}")
    low = F.lower(name)
    if len(parts) == 1:
        return F.when(low == pattern.lower(), "")
    before, after = parts
    fits = low.startswith(before.lower()) & low.endswith(after.lower()) & (F.length(name) >= len(before) + len(after))
    return F.when(fits, F.substring(name, F.lit(len(before) + 1), F.length(name) - len(before) - len(after)))


def _inserted(pattern: str, taken: Column) -> Column:
    before, _, after = pattern.partition("*")
    return F.concat(F.lit(before), taken, F.lit(after)) if "*" in pattern else F.lit(pattern)


def alias(materials: DataFrame, pattern: str, into: str) -> DataFrame:
    """The further rows that an alias rule gives."""
    return materials.withColumn("_v", glob_capture(F.col("name"), pattern)).where("_v is not null").withColumn("name", _inserted(into, F.col("_v"))).drop("_v")


def crafted(materials: DataFrame, pattern: str, uses: int, unit: str, into: str, makes: int, made_unit: str, strict_compat: bool = False) -> DataFrame:
    """The further rows of a crafting rule: each application takes ``uses`` of the
    material and makes ``makes``. Whole packs are bought so that none is left.

    ``strict_compat`` exchanges the two multipliers, as older price lists did.
    Materials in another unit raise no error here; ``mismatched`` lists them.
    """
    hit = materials.withColumn("_v", glob_capture(F.col("name"), pattern)).where("_v is not null").where(F.col("amount_unit") == unit)
    g = gcd(F.lit(uses), F.col("amount_number"))
    packs, times = F.lit(uses) / g, F.col("amount_number") / g
    if strict_compat:
        packs, times = times, packs
    return hit.select(
        _inserted(into, F.col("_v")).alias("name"),
        (times * makes).cast("int").alias("amount_number"),
        F.lit(made_unit).alias("amount_unit"),
        (packs * F.col("copper")).cast("long").alias("copper"),
        "reference",
    )


def mismatched(materials: DataFrame, pattern: str, unit: str) -> DataFrame:
    return materials.where(glob_capture(F.col("name"), pattern).isNotNull() & (F.col("amount_unit") != unit))


def extended(materials: DataFrame, *further: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all materials, names given twice): derived rows may not repeat a name."""
    rows = materials
    for f in further:
        rows = rows.unionByName(f)
    twice = rows.groupBy(F.lower("name").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows, twice


def variants(rows: DataFrame, names: str, contexts: str, prices: str) -> DataFrame:
    """A row for each name with the context and price of its place; rows whose
    lists differ in length give none."""
    even = (F.size(names) == F.size(contexts)) & (F.size(names) == F.size(prices))
    zipped = rows.where(even).select("*", F.posexplode(F.arrays_zip(F.col(names).alias("n"), F.col(contexts).alias("c"), F.col(prices).alias("p"))).alias("place", "z"))
    return zipped.select(*[c for c in rows.columns if c not in (names, contexts, prices)], "place", F.col("z.n").alias("name"), F.col("z.c").alias("context"), F.col("z.p").alias("price"))


def defined_once(rows: DataFrame, name: str, what: str, fold_case: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows whose name is defined once or first, rejects with reason) of definitions
    with an order column ``at``: of a name given again the first definition stands
    and the later ones are refused. Names of materials ignore case, those of units
    don't. Counts are made before the shuffle; only names given twice are looked up."""
    key = F.lower(name) if fold_case else F.col(name)
    first = rows.groupBy(key.alias("_key")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    met = rows.withColumn("_key", key).join(first, "_key", "left").drop("_key")
    later = F.coalesce(F.col("at") > F.col("_first"), F.lit(False))
    reason = F.concat(F.lit(f"{what} '"), F.col(name), F.lit("' already exists"))
    return met.where(~later).drop("_first"), met.where(later).drop("_first").withColumn("reason", reason)
