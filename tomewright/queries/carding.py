"""Cards and details of two kinds of entries, and definitions given twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tomewright.functions import cards
from tomewright.operators.materials import defined_once
from tomewright.plans.dialects import POWER_LEVELS
from tomewright.queries import query, table
from tomewright.queries.parsing import digits, size


@query("""SELECT p_partkey, 'Material ' || chr(39) || p_name || chr(39) || ' already exists' AS reason FROM (SELECT *, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS first FROM part) WHERE p_partkey > first""")
def duplicate_definitions(spark, sf_dir):
    """Definitions of a name that is there, in any case; the first one stands."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    _, bad = defined_once(table(spark, sf_dir, "part").select(k.alias("at"), name.alias("name"), "p_name"), "name", "Material")
    return bad.select(F.col("at").alias("p_partkey"), F.replace("reason", F.col("name"), F.col("p_name")).alias("reason"))


@query("SELECT p_brand AS unit, count(*) - 1 AS n_refused FROM part GROUP BY p_brand")
def duplicate_units(spark, sf_dir):
    """Units by their exact name: how many later definitions each one refuses."""
    good, bad = defined_once(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("at"), F.col("p_brand").alias("unit")), "unit", "Unit", fold_case=False)
    refused = bad.groupBy("unit").agg(F.count(F.lit(1)).alias("n_refused"))
    return good.select("unit").join(refused, "unit", "left").fillna(0, ["n_refused"])


def _component(display: Column, tag: str, used: bool, consumed: bool, price: Column) -> Column:
    return F.struct(
        display.alias("display"), F.lit(tag).alias("tag"), F.lit(used).alias("used"), F.lit(consumed).alias("consumed"), price.cast("long").alias("price"), F.when(size() % 2 == 0, "r").alias("reference")
    )


_ROW = "<tr><th>{0}</th><td>' || {1} || '</td></tr>"
_POWER = _ROW.format("Power Level", "power || CASE WHEN dc > 0 THEN ' (DV ' || dc || ')' ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ' (C)' ELSE '' END")
_TIME = _ROW.format("Casting Time", "p_size || ' [min]' || CASE WHEN p_size % 3 = 0 THEN ' (R)' ELSE '' END")
_PRICE = "CASE WHEN p_size % 2 = 0 THEN '<a href=\"r\"> (' || p_size || ' cu)</a>' ELSE ' (' || p_size || ' cu)' END"
_LISTED = _ROW.format("Components", f"p_name || '<sup>N</sup><sup>C</sup>, ' || p_brand || '<sup>U</sup>' || CASE WHEN p_size % 7 = 0 THEN '' ELSE '<b class=\"price\">' || {_PRICE} || '</b>' END")
_METRES = _ROW.format("Distance", "p_size || ' m'")


@query(f"""WITH x AS (SELECT *, ['Generalist', 'Petty', 'Lesser', 'Greater', 'Ritual'][1 + p_size % 5] AS power, [15, 15, 22, 30, 0][1 + p_size % 5] AS dc FROM part)
 SELECT p_partkey, '<table>{_ROW.format("Arcanum", "p_type")}{_POWER}{_TIME}' || CASE WHEN p_size % 4 = 0 THEN '{_METRES}' ELSE '' END || '{_LISTED}</table><p><p><b>Effect: </b>' || p_name
 || '</p><p><b>Succeeding &geq; 10: </b>s</p><p><b>Failing &leq; 5: </b>f</p>' || CASE WHEN p_size % 6 = 0 THEN '<hr/><div class="extra">more</div>' ELSE '' END || '</p>' AS card FROM x""")
def arcane_cards(spark, sf_dir):
    """Details of entries of the second dialect, with marks, prices and links."""
    listed = F.array(_component(F.col("p_name"), "NATURAL", False, True, size()), _component(F.col("p_brand"), "MISC", True, False, F.when(size() % 7 != 0, size())))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.col("p_type").alias("arcanum"), F.element_at(F.array(*map(F.lit, POWER_LEVELS)), (size() % 5 + 1).cast("int")).alias("power_level"), (size() % 2 == 0).alias("combat"), (size() % 3 == 0).alias("reaction"),
        F.concat(digits(), F.lit(" [min]")).alias("casting_time"), F.when(size() % 4 == 0, F.concat(digits(), F.lit(" m"))).alias("distance"), F.lit("").alias("duration"), listed.alias("components"), F.when(size() % 6 == 0, "more").alias("extra"),
    )
    shown = cards.priced_components(F.col("components"), lambda p: F.concat(p.cast("string"), F.lit(" cu")))
    body = cards.arcane_body(F.col("p_name"), F.lit("s"), F.lit("f"), F.col("extra"))
    return rows.select("p_partkey", cards.card(cards.arcane_fields(POWER_LEVELS, shown), body).alias("card"))


@query("""SELECT p_partkey, '<div class="tag-list"><div class="tag-box">' || CASE WHEN p_size % 4 = 0 THEN 'Cantrip' ELSE 'Fire' END || '</div><div class="tag-box">' || p_type || '</div></div>' AS tags,
 '<b>Traditions</b> ' || p_brand || ', Occult<br/><b>Level</b> ' || CASE WHEN p_size % 4 = 0 THEN 'Cantrip ' ELSE 'Spell ' END || p_size || '<br/><b>Cast</b> ' || CASE WHEN p_size % 9 = 0 THEN '<img src="/img/Two Actions.png"/> V' ELSE '1 minute; V' END || CASE WHEN p_size % 3 = 0 THEN '<br/><b>Trigger</b> hit' ELSE '' END
 || CASE WHEN p_size % 2 = 0 THEN '<br/><b>Range</b> ' || p_size || ' feet; <b>Targets</b> one' WHEN p_size % 5 = 0 THEN '<br/><b>Targets</b> one' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN '<br/><b>Save</b> Will' ELSE '' END AS properties, p_brand || ' (pg. ' || p_size || ')' AS origin FROM part""")
def traited_cards(spark, sf_dir):
    """Tags, property lines and origins of entries of the third dialect."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", F.array(F.when(size() % 4 == 0, "Cantrip").otherwise("Fire"), "p_type").alias("tags"), F.array("p_brand", F.lit("Occult")).alias("traditions"), size().alias("level"),
        F.when(size() % 9 == 0, "Two Actions").otherwise("1 minute").alias("casting_time"), F.lit("V").alias("components"), F.when(size() % 3 == 0, "hit").alias("reaction"), F.when(size() % 2 == 0, F.concat(digits(), F.lit(" feet"))).alias("range"),
        none.alias("area"), F.when((size() % 2 == 0) | (size() % 5 == 0), "one").alias("targets"), F.when(size() % 7 == 0, "Will").alias("save"), F.lit("").alias("duration"),
    )
    return rows.select("p_partkey", cards.tag_list(F.col("tags")).alias("tags"), cards.properties(cards.traited_lines()).alias("properties"), cards.page_origin(F.col("p_brand"), F.col("level")).alias("origin"))
