"""Units, materials, components and cost sheets over parts, orders and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.money import format_price, format_sum, scaled
from tomewright.functions.parsing import gcd
from tomewright.operators.costs import cost_totals, price_sums
from tomewright.operators.materials import alias, crafted, extended, glob_capture, mismatched, normalized, resolve_components, variants
from tomewright.operators.rules import extended_by
from tomewright.queries import query, table

#: Units in base units; 1 has no unit.
UNITS = [("1", 1, "1"), ("g", 1, "g"), ("kg", 1000, "g"), ("drop", 1, "drop"), ("drops", 1, "drop"), ("ml", 2, "drop"), ("l", 2000, "drop"), ("cm", 1, "cm"), ("m", 100, "cm"), ("cm^2", 1, "cm^2")]
_UNITS = "(VALUES " + ", ".join(f"('{n}', {k}, '{b}')" for n, k, b in UNITS) + ") u(uname, base_number, base_unit)"


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(UNITS, "name string, base_number int, base_unit string")


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A material for each part name: amounts and prices follow the name's first part."""
    first = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("k"))
    return first.select(
        "name", (F.col("k") % 5 + 1).cast("int").alias("amount_number"), F.when(F.col("k") % 3 == 0, "g").otherwise("1").alias("amount_unit"),
        (F.col("k") * 10).alias("copper"), F.concat(F.lit("ref"), F.col("k").cast("string")).alias("reference"),
    )


_MATERIALS = """m AS (SELECT p_name AS name, CAST(min(p_partkey) % 5 + 1 AS INT) AS amount_number, CASE WHEN min(p_partkey) % 3 = 0 THEN 'g' ELSE '1' END AS amount_unit,
 min(p_partkey) * 10 AS copper, 'ref' || min(p_partkey) AS reference FROM part GROUP BY ALL)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as components: names as they are, as plurals and unknown; several units."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    n = F.col("l_partkey") % 4
    name = F.when(n == 0, F.concat("p_name", F.lit("s"))).when(n == 1, F.upper("p_name")).when(n == 2, F.concat(F.lit("no "), "p_name")).otherwise(F.col("p_name"))
    unit = F.when(F.col("l_suppkey") % 5 == 0, "kg").when(F.col("l_suppkey") % 5 == 1, "parsec").otherwise("1")
    return line.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("number"), unit.alias("unit"), name.alias("name"), (F.col("l_returnflag") == "R").alias("consumed"))


_COMPONENTS = """c AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS number, CASE l_suppkey % 5 WHEN 0 THEN 'kg' WHEN 1 THEN 'parsec' ELSE '1' END AS unit,
 CASE l_partkey % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN upper(p_name) WHEN 2 THEN 'no ' || p_name ELSE p_name END AS name, l_returnflag = 'R' AS consumed FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_PRICED = f"""{_MATERIALS}, {_COMPONENTS}, r AS (SELECT c.*, base_unit, base_number,
 coalesce(a.amount_unit, b.amount_unit) AS au, coalesce(a.amount_number, b.amount_number) AS an, coalesce(a.copper, b.copper) AS cu, coalesce(a.reference, b.reference) AS ref
 FROM c LEFT JOIN {_UNITS} ON unit = uname LEFT JOIN m a ON lower(a.name) = lower(c.name)
 LEFT JOIN m b ON a.name IS NULL AND unit = '1' AND ends_with(lower(c.name), 's') AND lower(b.name) = lower(c.name)[:-2]),
 p AS (SELECT l_orderkey, l_linenumber, number, unit, name, consumed, CASE WHEN au = base_unit THEN CAST(CAST(number AS BIGINT) * base_number * cu AS DOUBLE) / an END AS price, CASE WHEN base_unit IS NOT NULL THEN ref END AS reference FROM r)"""


def priced(spark, sf_dir):
    return resolve_components(components(spark, sf_dir), units(spark), materials(spark, sf_dir))


@query(f"WITH {_PRICED} SELECT l_orderkey, l_linenumber, price, reference FROM p")
def component_price(spark, sf_dir):
    """Units, names, plurals and units that don't agree, all at once."""
    return priced(spark, sf_dir).select("l_orderkey", "l_linenumber", "price", "reference")


@query(f"WITH {_PRICED} SELECT l_orderkey, l_linenumber, price FROM p WHERE unit = '1' AND ends_with(name, 's') AND price IS NOT NULL")
def plural_fallback(spark, sf_dir):
    return priced(spark, sf_dir).where("unit = '1' and endswith(name, 's') and price is not null").select("l_orderkey", "l_linenumber", "price")


@query(f"WITH {_PRICED} SELECT unit, count(*) AS n, count(price) AS n_priced, count(reference) AS n_referenced FROM p GROUP BY ALL")
def unit_mismatch(spark, sf_dir):
    """Units that don't agree lose the price and keep the reference."""
    return priced(spark, sf_dir).groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("n_priced"), F.count("reference").alias("n_referenced"))


@query(f"""WITH {_COMPONENTS} SELECT l_orderkey, l_linenumber, CAST(number AS BIGINT) * base_number AS base_amount, base_unit FROM c LEFT JOIN {_UNITS} ON unit = uname""")
def unit_normalize(spark, sf_dir):
    return normalized(components(spark, sf_dir), units(spark)).select("l_orderkey", "l_linenumber", "base_amount", "base_unit")


@query(f"""WITH {_MATERIALS} SELECT 'ground ' || name[5:] AS name, CAST(amount_number // gcd(4, amount_number) * 3 AS INT) AS amount_number, 'g' AS amount_unit,
 CAST(4 // gcd(4, amount_number) * copper AS BIGINT) AS copper, reference FROM m WHERE starts_with(lower(name), 'red ') AND amount_unit = 'g'""")
def derive_materials(spark, sf_dir):
    """A crafting rule: 4 g of red things each time make 3 g of ground ones."""
    return crafted(materials(spark, sf_dir), "Red *", 4, "g", "ground *", 3, "g")


@query(f"""WITH {_MATERIALS} SELECT 'ground ' || name[5:] AS name, CAST(4 // gcd(4, amount_number) * 3 AS INT) AS amount_number, 'g' AS amount_unit,
 CAST(amount_number // gcd(4, amount_number) * copper AS BIGINT) AS copper, reference FROM m WHERE starts_with(lower(name), 'red ') AND amount_unit = 'g'""")
def derive_materials_compat(spark, sf_dir):
    return crafted(materials(spark, sf_dir), "Red *", 4, "g", "ground *", 3, "g", strict_compat=True)


@query(f"WITH {_MATERIALS} SELECT name FROM m WHERE ends_with(lower(name), ' gear') AND amount_unit <> 'g'")
def derive_mismatched(spark, sf_dir):
    return mismatched(materials(spark, sf_dir), "* gear", "g").select("name")


@query(f"WITH {_MATERIALS} SELECT name[:-6] || ' cog' AS name, amount_number, amount_unit, copper, reference FROM m WHERE ends_with(lower(name), ' gear')")
def alias_glob(spark, sf_dir):
    return alias(materials(spark, sf_dir), "* Gear", "* cog")


#: A chain: the third rule needs the first, the fourth makes a name that is there.
RULES = [
    (1, "* ring", "* band", 6, "1", 2, "1"), (2, "Red *", "scarlet *", None, None, None, None), (3, "* band", "* hoop", None, None, None, None),
    (4, "scarlet hoop", "red ring", None, None, None, None), (5, "*gear", "cog *", 1, "kg", 3, "drops"),
]


def derived(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "step int, pattern string, into string, uses int, uses_unit string, makes int, makes_unit string")
    return extended_by(materials(spark, sf_dir), rules, units(spark))


def _chain() -> str:
    """The rules one after the other in SQL; s holds the materials so far, r the refused."""
    out, last = f"WITH {_MATERIALS}, s0 AS (SELECT name, CAST(amount_number AS BIGINT) AS n, amount_unit AS u, copper, 0 AS made FROM m)", "s0"
    steps = [
        ("ends_with(lower(name), ' ring')", "name[:-6] || ' band'", "u = '1'", "n // gcd(6, n) * 2", "'1'", "6 // gcd(6, n) * copper"),
        ("starts_with(lower(name), 'red ')", "'scarlet ' || name[5:]", "true", "n", "u", "copper"),
        ("ends_with(lower(name), ' band')", "name[:-6] || ' hoop'", "true", "n", "u", "copper"),
        ("lower(name) = 'scarlet hoop'", "'red ring'", "true", "n", "u", "copper"),
        ("ends_with(lower(name), 'gear')", "'cog ' || name[:-5]", "u = 'g'", "n // gcd(1000, n) * 3", "'drop'", "1000 // gcd(1000, n) * copper"),
    ]
    for k, (when, into, fits, n, u, copper) in enumerate(steps, 1):
        out += f""", c{k} AS (SELECT {into} AS name, CAST({n} AS BIGINT) AS n, {u} AS u, CAST({copper} AS BIGINT) AS copper, {k} AS made, {fits} AS fits FROM {last} WHERE {when}),
 j{k} AS (SELECT *, count(*) OVER (PARTITION BY lower(name), fits) AS same, (SELECT min(made) FROM {last} p WHERE lower(p.name) = lower(c{k}.name)) AS earlier FROM c{k}),
 s{k} AS (SELECT * FROM {last} UNION ALL SELECT name, n, u, copper, made FROM j{k} WHERE fits AND same = 1 AND earlier IS NULL)"""
        last = f"s{k}"
    return out


@query(f"{_chain()} SELECT name, n AS amount_number, u AS amount_unit, copper, made FROM s5")
def derive_by_rules(spark, sf_dir):
    """Part names under a table of rules, rule after rule."""
    return derived(spark, sf_dir)[0].drop("reference")


@query(_chain() + " UNION ALL ".join([""] + [f"SELECT made AS step, name, CASE WHEN NOT fits THEN 'unit' WHEN earlier = 0 THEN 'name is there' WHEN earlier > 0 THEN 'name made before' ELSE 'made twice' END AS reason FROM j{k} WHERE NOT (fits AND same = 1 AND earlier IS NULL)" for k in range(1, 6)])[len(" UNION ALL"):])
def derive_rejects(spark, sf_dir):
    """What the rules may not make, and why."""
    return derived(spark, sf_dir)[1]


@query("SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'b') AND ends_with(lower(p_name), 'r') THEN p_name[2:-2] END AS taken FROM part")
def glob_captures(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", glob_capture(F.col("p_name"), "B*r").alias("taken"))


@query(f"""WITH {_MATERIALS}, x AS (SELECT name FROM m UNION ALL SELECT name[:-6] || ' ring' FROM m WHERE ends_with(lower(name), ' gear')) SELECT lower(name) AS key, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1""")
def duplicate_materials(spark, sf_dir):
    """Derived names that are there already."""
    m = materials(spark, sf_dir)
    return extended(m, alias(m, "* gear", "* ring"))[1]


@query("SELECT n_nationkey, CAST(i AS INT) AS place, ['a', 'b'][i + 1] AS name, [n_name, 'x'][i + 1] AS context, CAST([1, 2][i + 1] AS INT) AS price FROM nation, range(2) t(i) WHERE n_nationkey % 2 = 0")
def variants_zip(spark, sf_dir):
    """Lists of equal length side by side; uneven ones give no rows."""
    rows = table(spark, sf_dir, "nation").select(
        "n_nationkey", F.array(F.lit("a"), F.lit("b")).alias("names"), F.array("n_name", F.lit("x")).alias("contexts"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("prices"),
    )
    return variants(rows, "names", "contexts", "prices")


@query("SELECT p_partkey, gcd(p_partkey, p_size) AS g FROM part")
def greatest_divisors(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", gcd(F.col("p_partkey"), F.col("p_size")).alias("g"))


_SUMS = f"""{_PRICED}, s AS (SELECT l_orderkey, coalesce(sum(price) FILTER (consumed), 0) AS consumed_sum, coalesce(list_sort(list(name) FILTER (consumed AND price IS NULL)), []) AS consumed_unknown,
 coalesce(sum(price) FILTER (NOT consumed), 0) AS kept_sum, coalesce(list_sort(list(name) FILTER (NOT consumed AND price IS NULL)), []) AS kept_unknown FROM p GROUP BY ALL)"""


def summed(spark, sf_dir):
    return price_sums(priced(spark, sf_dir), "l_orderkey", display="name")


@query(f"WITH {_SUMS} SELECT l_orderkey, round(consumed_sum, 3) AS consumed_sum, consumed_unknown, round(kept_sum, 3) AS kept_sum, kept_unknown FROM s")
def price_sum_unknown(spark, sf_dir):
    """Sums of what is consumed and what is kept, with the names that have no price."""
    return summed(spark, sf_dir).withColumn("consumed_sum", F.round("consumed_sum", 3)).withColumn("kept_sum", F.round("kept_sum", 3))


@query(f"""WITH {_SUMS}, n AS (SELECT *, l_orderkey % 3 AS casts FROM s) SELECT CAST(sum(casts) AS BIGINT) AS n_casts, count(*) FILTER (casts > 0) AS n_cast_entries,
 round(sum(kept_sum) FILTER (casts > 0)) AS kept_total, round(sum(consumed_sum * casts)) AS consumed_total, CAST(sum(len(kept_unknown) + len(consumed_unknown)) FILTER (casts > 0) AS BIGINT) AS n_unknown FROM n""")
def totals_by_casts(spark, sf_dir):
    out = cost_totals(summed(spark, sf_dir), F.col("l_orderkey") % 3)
    return out.withColumn("kept_total", F.round("kept_total")).withColumn("consumed_total", F.round("consumed_total"))


@query(f"""WITH {_SUMS} SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 0 ELSE round(consumed_sum * (l_orderkey % 3), 3) END AS cost, CAST(CASE l_orderkey % 3 WHEN 0 THEN 0 ELSE len(consumed_unknown) END AS INT) AS n_unknown FROM s""")
def scale_zero(spark, sf_dir):
    """Nothing times a price is nothing, unknown parts too."""
    value, unknown = scaled(F.col("consumed_sum"), F.col("consumed_unknown"), F.col("l_orderkey") % 3)
    return summed(spark, sf_dir).select("l_orderkey", F.round(value, 3).alias("cost"), F.size(unknown).alias("n_unknown"))


_FORMAT = """CASE WHEN c >= 432 THEN CAST(CAST(floor(c / 432) AS BIGINT) AS VARCHAR) || 'Ⓖ' ELSE '' END || CASE WHEN c % 432 >= 36 THEN CAST(CAST(floor((c % 432) / 36) AS BIGINT) AS VARCHAR) || 'Ⓢ' ELSE '' END
 || CASE WHEN c % 36 > 0 OR c = 0 THEN replace(printf('%.1f', c % 36), '.0', '') || 'Ⓒ' ELSE '' END"""


@query(f"SELECT p_partkey, {_FORMAT} AS price FROM (SELECT p_partkey, (p_partkey % 997) * 1.5::DOUBLE AS c FROM part)")
def format_prices(spark, sf_dir):
    copper = (F.col("p_partkey") % 997) * F.lit(1.5)
    return table(spark, sf_dir, "part").select("p_partkey", format_price(copper).alias("price"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND c = 0 THEN '???' WHEN p_partkey % 3 = 0 THEN {_FORMAT} || '+?' ELSE {_FORMAT} END AS price FROM (SELECT p_partkey, CAST(p_partkey % 10 * 50 AS DOUBLE) AS c FROM part)")
def format_price_sums(spark, sf_dir):
    value = (F.col("p_partkey") % 10 * 50).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", format_sum(value, F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).alias("price"))
