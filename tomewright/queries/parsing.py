"""Parsers over texts made from the part table, so that SQL knows the answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions import cards
from tomewright.functions import parsing as p
from tomewright.functions.text import occurrences
from tomewright.queries import query, table

def size() -> Column:
    return F.col("p_size")


def digits() -> Column:
    return size().cast("string")


def _made(spark, sf_dir, text, parser, *fields):
    x = table(spark, sf_dir, "part").withColumn("x", parser(text))
    return x.select("p_partkey", *(f"x.{f}" for f in fields))


@query("""SELECT p_partkey, p_size % 4 <> 3 AS ok, CASE WHEN p_size % 4 = 0 THEN 0 WHEN p_size % 4 < 3 THEN p_size END::INT AS level,
 CASE WHEN p_size % 4 = 3 THEN 'cooking' ELSE 'illusion' END AS school, p_size % 4 = 2 AS ritual FROM part""")
def parse_level(spark, sf_dir):
    m = size() % 4
    text = F.when(m == 0, "Illusion cantrip").when(m == 1, F.concat(digits(), F.lit("th-level Illusion"))).when(m == 2, F.concat(digits(), F.lit("th-Level illusion (ritual)"))).otherwise("9x cooking")
    return _made(spark, sf_dir, text, p.parse_level, "ok", "level", "school", "ritual")


@query("SELECT p_partkey, p_size % 3 <> 2 AS ok, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'V, S' END AS before, CASE p_size % 3 WHEN 1 THEN p_name WHEN 2 THEN 'b' END AS inner_text FROM part")
def parse_paren(spark, sf_dir):
    m = size() % 3
    text = F.when(m == 0, F.col("p_name")).when(m == 1, F.concat(F.lit("V, S ("), "p_name", F.lit(")"))).otherwise("V, S (a (b)")
    return _made(spark, sf_dir, text, p.parse_paren, "ok", "before", "inner").withColumnRenamed("inner", "inner_text")


@query("SELECT p_partkey, p_size % 3 <> 2 AS ok, p_size % 3 <> 0 AS concentration, CASE p_size % 3 WHEN 2 THEN '' ELSE p_size || ' minutes' END AS duration FROM part")
def parse_duration(spark, sf_dir):
    m = size() % 3
    text = F.when(m == 0, F.concat(digits(), F.lit(" minutes "))).when(m == 1, F.concat(F.lit("Concentration,  up to "), digits(), F.lit(" minutes"))).otherwise("Concentration")
    return _made(spark, sf_dir, text, p.parse_duration, "ok", "concentration", "duration")


@query("""SELECT p_partkey, p_size % 5 IN (0, 1) AS ok, true AS verbal, p_size % 5 <> 2 AS somatic, CASE WHEN p_size % 5 IN (1, 4) THEN p_name END AS materials FROM part""")
def parse_components(spark, sf_dir):
    m = size() % 5
    text = F.when(m == 0, "V, S").when(m == 1, F.concat(F.lit("V,s, M ("), "p_name", F.lit(")"))).when(m == 2, "V, V").when(m == 3, "V, S, M").otherwise(F.concat(F.lit("V, S ("), "p_name", F.lit(")")))
    return _made(spark, sf_dir, text, p.parse_components, "ok", "verbal", "somatic", "materials")


@query("SELECT p_partkey, p_size % 4 <> 3 AS ok, CASE WHEN p_size % 4 <> 3 THEN p_size END AS number, CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN 'kg' WHEN 2 THEN 'ml' ELSE '[g' END AS unit FROM part")
def parse_amount(spark, sf_dir):
    m = size() % 4
    text = F.concat(digits(), F.when(m == 0, "").when(m == 1, " [kg]").when(m == 2, "ml").otherwise(" [g"))
    return _made(spark, sf_dir, text, p.parse_amount, "ok", "number", "unit")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size * 432 + 36 WHEN 1 THEN p_size END::BIGINT AS copper FROM part")
def parse_price(spark, sf_dir):
    m = size() % 3
    text = F.concat(digits(), F.when(m == 0, r" \Au 1\Ag").when(m == 1, r"\Cu ").otherwise(r" \Au and more"))
    return table(spark, sf_dir, "part").select("p_partkey", p.parse_price(text).alias("copper"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE p_size END AS number, CASE p_size % 5 WHEN 0 THEN 'g' WHEN 3 THEN 'ml' ELSE '1' END AS unit, p_name AS name FROM part""")
def component_grammar(spark, sf_dir):
    m = size() % 5
    name = F.col("p_name")
    text = (
        F.when(m == 0, F.concat(digits(), F.lit(" [g] of "), name)).when(m == 1, F.concat(F.lit("An "), name)).when(m == 2, F.concat(digits(), F.lit(" "), name))
        .when(m == 3, F.concat(name, F.lit(" ("), digits(), F.lit(" [ml])"))).otherwise(name)
    )
    x = table(spark, sf_dir, "part").withColumn("x", p.component(text))
    return x.select("p_partkey", "x.*")


@query("SELECT p_partkey, ['a sandy thing', p_name, 'salt', 'oil'] AS pieces FROM part")
def component_split(spark, sf_dir):
    text = F.concat(F.lit("a sandy thing, "), "p_name", F.lit(" and salt,and oil, "))
    return table(spark, sf_dir, "part").select("p_partkey", p.split_components(text).alias("pieces"))


@query("SELECT p_partkey, p_name AS display, p_size % 2 = 0 AS consumed, p_size % 3 = 0 AS used, CASE p_size % 4 WHEN 0 THEN 'QUEST' WHEN 1 THEN 'FORAGE' ELSE 'MISC' END AS tag FROM part")
def component_marks(spark, sf_dir):
    text = F.concat("p_name", F.when(size() % 2 == 0, r" \Consumed.").otherwise("."), F.when(size() % 3 == 0, r"\use ").otherwise(""), F.when(size() % 4 == 0, r" \Quest").when(size() % 4 == 1, r"\Forage.").otherwise(""))
    return _made(spark, sf_dir, text, p.component_flags, "display", "consumed", "used", "tag")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || ' AcP' WHEN 1 THEN '1 AcP or so' ELSE '1 hour' END AS casting_time, p_size % 3 = 1 AS reaction FROM part")
def cast_time_rewrite(spark, sf_dir):
    m = size() % 3
    text = F.when(m == 0, F.concat(F.lit(r"\action["), digits(), F.lit("]"))).when(m == 1, r"\action* or so").otherwise("1 hour")
    return _made(spark, sf_dir, text, p.cast_time, "casting_time", "reaction")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '<img src="/img/Reaction.png">' WHEN 1 THEN '<img src="/img/Single Action.png"> to <img src="/img/Three Actions.png">' END AS icons FROM part""")
def action_icon_images(spark, sf_dir):
    text = F.when(size() % 3 == 0, "Reaction").when(size() % 3 == 1, "Single Action to Three Actions").otherwise("1 minute")
    return table(spark, sf_dir, "part").select("p_partkey", p.action_icons(text).alias("icons"))


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_returnflag = 'R' THEN 'V' END, CASE WHEN l_linestatus = 'O' THEN 'S' END, CASE WHEN l_tax > 0.04 THEN 'M' END], lambda x: x IS NOT NULL), ', ') AS components FROM lineitem")
def component_string(spark, sf_dir):
    each = F.array(F.when(F.col("l_returnflag") == "R", "V"), F.when(F.col("l_linestatus") == "O", "S"), F.when(F.col("l_tax") > 0.04, "M"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_compact(each), ", ").alias("components"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 THEN [p_size || ' gp'] ELSE [] END AS costs, p_size % 2 = 0 AS consumed FROM part""")
def expensive_flags(spark, sf_dir):
    """Costs of ten gold or more, and whether the materials are consumed."""
    text = F.concat(F.lit("dust worth "), digits(), F.lit(" gp"), F.when(size() % 2 == 0, ", which the spell consumes").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", cards.costs(text).alias("costs"), cards.used_up(text).alias("consumed"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'light' WHEN p_size % 3 = 1 THEN 'dark' END AS arcanum, p_size % 3 <> 2 AS is_row FROM part WHERE p_size % 5 <> 0")
def arcanum_tags(spark, sf_dir):
    """Tags a:b[:c]; those of the arcanum itself are no rows and vanish."""
    m = size() % 3
    tag = F.when(size() % 5 == 0, "arc:light").when(m == 0, "x:light:1").when(m == 1, "x:dark").otherwise("x")
    second = F.get(F.split(tag, ":"), F.lit(1))
    rows = table(spark, sf_dir, "part").where(~tag.startswith("arc:"))
    return rows.select("p_partkey", second.alias("arcanum"), second.isNotNull().alias("is_row"))


_M = "CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 'dust worth ' || p_size || ' gp' || CASE WHEN p_size % 2 = 0 THEN ', consumed by the spell' ELSE '' END ELSE 'wool' END"


@query(f"""WITH x AS (SELECT *, p_size % 11 AS lv, {_M} AS m FROM part)
 SELECT p_partkey, CASE WHEN lv = 0 THEN p_type || ' Cantrip' ELSE lv || CASE lv WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || '-level ' || p_type END AS title,
 'V' || CASE WHEN p_size % 2 = 0 THEN ', S' ELSE '' END || CASE WHEN m IS NULL THEN '' WHEN p_size % 3 = 1 AND p_size >= 10 THEN ', <b>M' || CASE WHEN p_size % 2 = 0 THEN '*' ELSE '' END || '</b> ('
 || replace(m, p_size || ' gp', '<b>' || p_size || ' gp</b>') || ')' ELSE ', M (' || m || ')' END AS components,
 CASE WHEN p_size % 5 = 0 THEN p_brand || ' (p. ' || p_size || ')' ELSE p_brand END AS origin FROM x""")
def card_projection(spark, sf_dir):
    level = size() % 11
    m = size() % 3
    materials = F.when(m == 1, F.concat(F.lit("dust worth "), digits(), F.lit(" gp"), F.when(size() % 2 == 0, ", consumed by the spell").otherwise(""))).when(m == 2, "wool")
    hint = F.when(size() % 5 == 0, F.concat(F.lit("p. "), digits()))
    return table(spark, sf_dir, "part").select(
        "p_partkey", cards.level_line(level, F.col("p_type")).alias("title"), cards.component_line(F.lit(True), size() % 2 == 0, materials).alias("components"),
        cards.origin_line(F.col("p_brand"), hint).alias("origin"),
    )


@query("""SELECT p_partkey, '<table><tr><th>Type</th><td>' || p_type || '</td></tr>' || CASE WHEN p_size % 2 = 0 THEN '<tr><th>Duration</th><td>Concentration, up to ' || p_size || ' minutes</td></tr>'
 ELSE '<tr><th>Duration</th><td>' || p_size || ' minutes</td></tr>' END || '</table><p>' || p_name || '</p>' AS card FROM part""")
def detail_projection(spark, sf_dir):
    """A field without a value has no line."""
    lasts = cards.duration_line(size() % 2 == 0, F.concat(digits(), F.lit(" minutes")))
    fields = [("Type", F.col("p_type")), ("Area", F.lit(None).cast("string")), ("Duration", lasts)]
    return table(spark, sf_dir, "part").select("p_partkey", cards.card(fields, F.col("p_name")).alias("card"))


@query("SELECT p_partkey, list_filter(range(0, len(p_name)), lambda i: substr(p_name, i + 1, 2) = 'an') AS places FROM part")
def find_indices(spark, sf_dir):
    """All places of a needle, overlapping ones too."""
    return table(spark, sf_dir, "part").select("p_partkey", occurrences(F.col("p_name"), "an").alias("places"))
