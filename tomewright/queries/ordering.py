"""Sort orders as rank columns, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.functions.quantity import ACTION_UNITS, computed, distance, duration, least_quantity, ranks
from tomewright.operators.ranking import ranked, ranked_by_value
from tomewright.plans.dialects import ARCANA, ARCANE, POWER_LEVELS, TRAITED
from tomewright.plans.search import Dialect
from tomewright.plans.sorting import card_order, sort_order
from tomewright.queries import query, table
from tomewright.queries.searching import parts

_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _rank(rows, sorting, d, keep=("p_partkey",)):
    return ranked(rows, sort_order(sorting, d, [F.col(keep[0]).asc()], rows)).select(*keep, "rank")


def _sql(order: str, select: str = "p_partkey", frm: str = "part") -> str:
    return f"SELECT {select}, row_number() OVER (ORDER BY {order}) AS rank FROM {frm}"


@query(_sql("p_size DESC, p_partkey"))
def sort_polarity_plain(spark, sf_dir):
    """A plain column: descending unless reversed."""
    return _rank(parts(spark, sf_dir), "level", Dialect())


@query(_sql("p_size, p_partkey"))
def sort_polarity_reversed(spark, sf_dir):
    return _rank(parts(spark, sf_dir), "-level", Dialect())


@query(_sql("p_size, p_partkey"))
def sort_polarity_custom(spark, sf_dir):
    """A column with a comparer: ascending unless reversed."""
    return _rank(parts(spark, sf_dir), "level", Dialect(comparers={"level": lambda: [F.col("level")]}))


@query(_sql("p_name, p_partkey"))
def sort_default(spark, sf_dir):
    return _rank(parts(spark, sf_dir), None, Dialect())


@query(_sql("p_size, p_name, p_partkey"))
def card_ranks(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return ranked(rows, [*card_order(Dialect(level="level")), F.col("p_partkey")]).select("p_partkey", "rank")


@query(_sql("p_type DESC, p_size, p_name, p_partkey"))
def sort_after_cards(spark, sf_dir):
    """An explicit sorting keeps the card order among equals."""
    rows, d = parts(spark, sf_dir), Dialect(level="level")
    return ranked(rows, sort_order("school", d, [*card_order(d), F.col("p_partkey")], rows)).select("p_partkey", "rank")


@query(_sql("length(p_name), p_name, p_partkey"))
def sort_length_then_text(spark, sf_dir):
    return _rank(parts(spark, sf_dir), "name", Dialect(comparers={"name": lambda: [F.length("name"), F.col("name")]}))


_ACCENTS = """n AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') WHEN 2 THEN upper(replace(p_name, 'e', 'é')) ELSE p_name END AS name FROM part)"""
_LETTERS = "strip_accents(lower({0})), lower({0}), translate({0}, 'abcdefghijklmnopqrstuvwxyzéABCDEFGHIJKLMNOPQRSTUVWXYZÉ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZÉabcdefghijklmnopqrstuvwxyzé')"


def accented(spark, sf_dir):
    """Part names in both cases, with and without accents."""
    k, name = F.col("p_partkey") % 4, F.col("name")
    with_ = F.replace(name, F.lit("e"), F.lit("é"))
    return parts(spark, sf_dir).withColumn("name", F.when(k == 0, F.upper(name)).when(k == 1, with_).when(k == 2, F.upper(with_)).otherwise(name))


@query(f"WITH {_ACCENTS} SELECT p_partkey, row_number() OVER (ORDER BY {_LETTERS.format('name')}, p_partkey) AS rank FROM n")
def sort_in_language(spark, sf_dir):
    """Cards by letters first, then accents, then case."""
    rows, d = accented(spark, sf_dir), Dialect(cards=("name",), local=True)
    return ranked(rows, [*card_order(d), F.col("p_partkey")]).select("p_partkey", "rank")


@query(f"WITH {_ACCENTS} SELECT p_partkey, row_number() OVER (ORDER BY {_LETTERS.format('name')} , p_partkey) AS rank FROM n".replace("ORDER BY", "ORDER BY length(name),"))
def sort_components_in_language(spark, sf_dir):
    rows = accented(spark, sf_dir).select("p_partkey", F.col("name").alias("components"))
    return _rank(rows, "components", TRAITED)


@query(f"WITH {_ACCENTS}, r AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS feet FROM n) SELECT p_partkey, row_number() OVER (ORDER BY feet, CASE WHEN feet = 0 THEN strip_accents(lower(name)) END, CASE WHEN feet = 0 THEN lower(name) END, CASE WHEN feet = 0 THEN {_LETTERS.format('name').split('), ', 2)[2]} END, p_partkey) AS rank FROM r")
def sort_range_in_language(spark, sf_dir):
    """By feet; ranges without any by their text."""
    rows = accented(spark, sf_dir).select("p_partkey", F.col("name").alias("range"), F.when(F.col("level") % 3 == 0, F.col("level")).otherwise(0).alias("feet"))
    return _rank(rows, "range", TRAITED)


@query("SELECT p_partkey, row_number() OVER (ORDER BY CASE p_size % 5 WHEN 0 THEN 15 WHEN 1 THEN 15 WHEN 2 THEN 22 WHEN 3 THEN 30 ELSE 0 END, p_partkey) AS rank FROM part")
def sort_power_level(spark, sf_dir):
    """By the difficulty of the level; some levels share one."""
    names = F.array(*map(F.lit, POWER_LEVELS))
    return _rank(parts(spark, sf_dir).select("p_partkey", F.element_at(names, (F.col("level") % 5 + 1).cast("int")).alias("power_level")), "power_level", ARCANE)


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 9 DESC, p_partkey) AS rank FROM part")
def sort_arcanum(spark, sf_dir):
    """Arcana in their fixed order, reversed."""
    names = F.array(*map(F.lit, ARCANA))
    return _rank(parts(spark, sf_dir).select("p_partkey", F.element_at(names, (F.col("level") % 9 + 1).cast("int")).alias("arcanum")), "-arcanum", ARCANE)


_FEET = "CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END"


@query(_sql(f"{_FEET}, CASE WHEN p_size % 5 = 0 THEN p_type END, p_partkey"))
def sort_feet_then_text(spark, sf_dir):
    """By feet; rows without any by their text."""
    rows = parts(spark, sf_dir).withColumn("feet", F.when(F.col("level") % 5 == 0, 0).otherwise(F.col("level")))
    return _rank(rows, "feet", Dialect(comparers={"feet": lambda: [F.col("feet"), F.when(F.col("feet") == 0, F.col("school"))]}))


@query("SELECT o_orderkey, CAST(CAST(o_orderpriority[1] AS INT) - 1 AS INT) AS priority_rank FROM orders")
def sort_enum_rank(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ranks(_PRIORITY, F.col("o_orderpriority")).alias("priority_rank"))


_CAST = """CASE p_size % 6 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' minutes' WHEN 1 THEN '1 action or ' || p_size || ' minutes' WHEN 2 THEN p_size || ' hours'
 WHEN 3 THEN '1 Bonus Action' WHEN 4 THEN 'special' ELSE '0 reaction' END"""
_CAST_VALUE = "CASE p_size % 6 WHEN 0 THEN p_size * 60 WHEN 1 THEN least(3, p_size * 60) WHEN 2 THEN p_size * 3600 WHEN 3 THEN 2 WHEN 4 THEN NULL ELSE 0 END"


def _casting(spark, sf_dir):
    n, s = F.col("level") % 6, F.col("level").cast("string")
    text = (
        F.when(n == 0, F.concat(s, F.lit(" minutes"))).when(n == 1, F.concat(F.lit("1 action or "), s, F.lit(" minutes"))).when(n == 2, F.concat(s, F.lit(" hours")))
        .when(n == 3, "1 Bonus Action").when(n == 4, "special").otherwise("0 reaction")
    )
    return parts(spark, sf_dir).withColumn("casting", text)


@query(f"SELECT p_partkey, CAST({_CAST_VALUE} AS DOUBLE) AS seconds FROM part")
def least_quantities(spark, sf_dir):
    return _casting(spark, sf_dir).select("p_partkey", least_quantity(F.col("casting"), ACTION_UNITS).alias("seconds"))


@query(f"""WITH x AS (SELECT p_partkey, {_CAST} AS t, CAST({_CAST_VALUE} AS DOUBLE) AS v FROM part)
 SELECT p_partkey, row_number() OVER (ORDER BY coalesce(v = 0, true), CASE WHEN v <> 0 THEN v END NULLS LAST, CASE WHEN coalesce(v = 0, true) THEN t END, p_partkey) AS rank FROM x""")
def sort_quantity(spark, sf_dir):
    """Valid quantities first; zero counts as none."""
    rows = _casting(spark, sf_dir)
    return ranked_by_value(rows, least_quantity(F.col("casting"), ACTION_UNITS), "casting", "p_partkey")


def _timed(spark, sf_dir):
    n, s = F.col("level") % 8, F.col("level").cast("string")
    text = (
        F.when(n == 0, "Instant").when(n == 1, "Eternal").when(n == 2, "eternal (until x)").when(n == 3, "varies").when(n == 4, F.concat(F.lit("2+"), s, F.lit("·4-6/2 [min]")))
        .when(n == 5, F.concat(F.lit("Wis · "), s, F.lit(" [h]"))).when(n == 6, "2d6 [h]").otherwise(F.concat(s, F.lit(" [M]")))
    )
    return parts(spark, sf_dir).withColumn("lasts", text)


_LASTS = """CASE p_size % 8 WHEN 0 THEN 0.1 WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN 1e20 WHEN 3 THEN NULL WHEN 4 THEN (2 + p_size * 4 - 3) * 60.0
 WHEN 5 THEN 6.0 * p_size * 3600 ELSE NULL END"""


@query(f"SELECT p_partkey, CAST({_LASTS} AS DOUBLE) AS seconds FROM part")
def durations(spark, sf_dir):
    """Keywords, arithmetic and units; a unit in another case is none."""
    return _timed(spark, sf_dir).select("p_partkey", duration(F.col("lasts")).alias("seconds"))


@query(f"""WITH x AS (SELECT p_partkey, p_size, CAST({_LASTS} AS DOUBLE) AS v FROM part), y AS (SELECT *, CASE p_size % 8 WHEN 3 THEN 'varies' WHEN 6 THEN '2d6 [h]'
 WHEN 7 THEN p_size || ' [M]' END AS t FROM x)
 SELECT p_partkey, row_number() OVER (ORDER BY v IS NULL, v NULLS LAST, CASE WHEN v IS NULL THEN t END NULLS LAST, p_partkey) AS rank FROM y""")
def sort_duration(spark, sf_dir):
    rows = _timed(spark, sf_dir)
    return ranked_by_value(rows, duration(F.col("lasts")), "lasts", "p_partkey")


def _ranged(spark, sf_dir):
    n, s = F.col("level") % 7, F.col("level").cast("string")
    text = (
        F.when(n == 0, "Touch").when(n == 1, "any").when(n == 2, "Vision").when(n == 3, F.concat(F.lit("Vision (maximum "), s, F.lit(" [m])")))
        .when(n == 4, F.concat(s, F.lit(" [km] radius"))).when(n == 5, F.concat(s, F.lit(" [m]"))).otherwise(F.concat(s, F.lit(" feet")))
    )
    return parts(spark, sf_dir).withColumn("reach", text)


_REACH = "CASE p_size % 7 WHEN 0 THEN 0.1 WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN 5000 WHEN 3 THEN p_size WHEN 4 THEN p_size * 1000 WHEN 5 THEN p_size END"


@query(f"SELECT p_partkey, CAST({_REACH} AS DOUBLE) AS metres FROM part")
def distances(spark, sf_dir):
    return _ranged(spark, sf_dir).select("p_partkey", distance(F.col("reach")).alias("metres"))


@query(f"""WITH x AS (SELECT p_partkey, p_size, CAST({_REACH} AS DOUBLE) AS v FROM part)
 SELECT p_partkey, row_number() OVER (ORDER BY v IS NULL, v NULLS LAST, CASE WHEN v IS NULL THEN p_size || ' feet' END NULLS LAST, p_partkey) AS rank FROM x""")
def sort_distance(spark, sf_dir):
    rows = _ranged(spark, sf_dir)
    return ranked_by_value(rows, distance(F.col("reach")), "reach", "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 10 = 1 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(p_size + 2 * 3 - 4.0 / CASE WHEN p_size % 10 = 1 THEN 1 ELSE 2 END AS DOUBLE) END AS value FROM part""")
def computations(spark, sf_dir):
    """Arithmetic in text, with division by zero and parts that are no numbers."""
    level = F.col("level")
    lead = F.when(level % 3 == 0, "?").otherwise(level.cast("string"))
    text = F.when((level % 10 == 1) & (level % 3 != 0), F.concat(lead, F.lit("/0"))).otherwise(F.concat(lead, F.lit("+2·3-4/2")))
    return parts(spark, sf_dir).select("p_partkey", computed(text).alias("value"))
