"""Search queries over the driver tables, seen as catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.text import infix
from tomewright.operators.lists import included, prepared_rows
from tomewright.plans.dialects import ARCANE, LEVELLED, TRAITED
from tomewright.plans.search import Dialect, compile_query, parse_query, saved_queries, search, search_with_members
from tomewright.queries import query, table
from tomewright.streaming.incremental import drained, searched_stream, windowed_counts

PARTS = Dialect(level="level", exact=("school",), headers=("level", "school"))
COSTED = Dialect(level="level", exact=("school",), materials="materials", priced=True, hint="hint")
TEXTS = Dialect(name="source", source="source", exact=("lang",), texts=("text",), flags=("toxic", "quality"))
LINES = Dialect(name="line", source=None, flags=("returned", "discounted"))
TRAITS = Dialect(exact=("range",), exact_lists=("tags",), save="save", components=None, level="level")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("school"), F.col("p_size").alias("level"), "p_retailprice"
    )


def found(spark: SparkSession, sf_dir: str, text: str, **options) -> DataFrame:
    return search(parts(spark, sf_dir), text, PARTS, **options).select("p_partkey", "name", "school", "level")


_PART = "SELECT p_partkey, p_name AS name, p_type AS school, p_size AS level FROM part WHERE "


def _has(x: str) -> str:
    return f"contains(lower(p_name), '{x}')"


@query(f"{_PART} {_has('red')} AND NOT {_has('ring')} AND ({_has('l1-20')} OR p_size BETWEEN 1 AND 20 OR {_has('blue')} OR p_type ILIKE 'blue')")
def dsl_and_or_not(spark, sf_dir):
    """Conjunction, alternatives, negation and a level range."""
    return found(spark, sf_dir, "red,!ring;L1-20|blue")


@query(f"{_PART} p_size BETWEEN 3 AND 5 OR {_has('l3-5')}")
def dsl_level_range(spark, sf_dir):
    return found(spark, sf_dir, "L3-5")


@query(f"{_PART} p_size = 7 OR {_has('l7')}")
def dsl_level_value(spark, sf_dir):
    return found(spark, sf_dir, "L7")


@query(f"{_PART} {_has('l3-5-7')} OR {_has('lx')} OR {_has('l6x')} OR p_size = 6")
def dsl_level_malformed(spark, sf_dir):
    """Three limits or no number never match; a number counts as far as it goes."""
    return found(spark, sf_dir, "L3-5-7|Lx|L6x")


@query(f"{_PART} lower(p_type) = 'economy' OR {_has('economy')}")
def dsl_exact_field(spark, sf_dir):
    return found(spark, sf_dir, "economy")


@query(f"{_PART} lower(p_name) = 'red widget' OR contains(lower(p_name), '\\red widget')")
def dsl_exact_name(spark, sf_dir):
    return found(spark, sf_dir, "\\Red  Widget")


@query(f"{_PART} lower(p_brand) = 'brand#12' OR contains(lower(p_name), ':brand#12')")
def dsl_source_term(spark, sf_dir):
    """``:x`` as documented: rows of the source x."""
    return found(spark, sf_dir, ":Brand#12")


@query(f"{_PART} contains(lower(p_name), ':brand#12') OR lower(p_brand) = ':brand#12'")
def dsl_source_term_compat(spark, sf_dir):
    """The same with the colon taken as part of the source."""
    return found(spark, sf_dir, ":Brand#12", strict_compat=True)


@query(f"{_PART} true")
def dsl_always_true(spark, sf_dir):
    return found(spark, sf_dir, "zzz|;,;")


@query(f"{_PART} false")
def dsl_never_true(spark, sf_dir):
    return found(spark, sf_dir, "red;!")


@query(f"{_PART} contains(lower(p_name), 'a.b*') OR contains(lower(p_name), '(x)') OR contains(lower(p_name), 'g')")
def dsl_metacharacters(spark, sf_dir):
    return found(spark, sf_dir, "a.b*|(x)|g")


@query(f"{_PART} NOT {_has('red')}")
def dsl_complement(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return rows.where(~compile_query("red", PARTS, rows)).select("p_partkey", "name", "school", "level")


def costed(spark, sf_dir):
    price = F.round("p_retailprice").cast("int").cast("string")
    return parts(spark, sf_dir).select(
        "p_partkey", "name", "school", "level", "source",
        F.when(F.col("level") % 3 != 0, F.concat(price, F.when(F.col("level") % 2 == 0, " gp").otherwise(" sp"))).alias("materials"),
        F.when(F.col("level") > 25, F.concat(F.lit("see "), F.col("source"))).alias("hint"),
    )


_COSTED = """WITH c AS (SELECT *, CASE WHEN p_size % 3 <> 0 THEN CAST(CAST(round(p_retailprice) AS INT) AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN ' gp' ELSE ' sp' END END AS m,
 CASE WHEN p_size > 25 THEN 'see ' || p_brand END AS h FROM part) SELECT p_partkey FROM c WHERE """


@query(f"{_COSTED} coalesce(regexp_matches(m, '[1-9][0-9,]+\\s*gp', 'i'), false) OR coalesce(contains(m, '$'), false) OR {_has('$$')}")
def dsl_costly_materials(spark, sf_dir):
    rows = costed(spark, sf_dir)
    return search(rows, "$$", COSTED).select("p_partkey")


@query(f"{_COSTED} coalesce(m <> '', false) OR {_has('material')}")
def dsl_any_material(spark, sf_dir):
    rows = costed(spark, sf_dir)
    return search(rows, "material", COSTED).select("p_partkey")


@query(f"{_COSTED} coalesce(contains(lower(m), '1 gp'), false) OR {_has('$1 gp')}")
def dsl_material_text(spark, sf_dir):
    rows = costed(spark, sf_dir)
    return search(rows, "$1 GP", COSTED).select("p_partkey")


@query(f"{_COSTED} coalesce(contains(lower(h), 'brand#2'), false) OR {_has('#brand#2')}")
def dsl_hint(spark, sf_dir):
    rows = costed(spark, sf_dir)
    return search(rows, "#Brand#2", COSTED).select("p_partkey")


def traits(spark, sf_dir):
    return parts(spark, sf_dir).select(
        "p_partkey", "name", "source", "level", F.lower("school").alias("range"), F.split("name", " ").alias("tags"),
        F.when(F.col("level") % 4 == 0, "basic Reflex").when(F.col("level") % 4 == 1, "Will").alias("save"),
    )


@query(f"SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR {_has('reflex')}")
def dsl_save(spark, sf_dir):
    return search(traits(spark, sf_dir), "REFLEX", TRAITS).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_type) = 'promo' OR contains(lower(p_name), 'promo') OR list_contains(string_split(lower(p_name), ' '), 'red') OR contains(lower(p_name), 'red')")
def dsl_exact_in_list(spark, sf_dir):
    return search(traits(spark, sf_dir), "promo|red", TRAITS).select("p_partkey")


@query("""WITH n AS (SELECT p_partkey, p_size, p_type, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, 'e', 'é') ELSE p_name END AS name FROM part)
 SELECT p_partkey FROM n WHERE lower(name) IN ('red gear', 'réd gear') OR contains(lower(name), chr(92) || 'red gear') OR contains(lower(name), chr(92) || 'réd gear')""")
def dsl_same_accents(spark, sf_dir):
    """Names that are the same but for case; accents count."""
    k, name = F.col("p_partkey") % 4, F.col("name")
    rows = parts(spark, sf_dir).withColumn("name", F.when(k == 0, F.upper(name)).when(k == 1, F.replace(name, F.lit("e"), F.lit("é"))).otherwise(name))
    return search(rows, "\\Red Gear|\\RÉD gear", PARTS).select("p_partkey")


def levelled_entries(spark, sf_dir):
    """Parts as entries of the first kind."""
    size = F.col("level")
    return parts(spark, sf_dir).select(
        "p_partkey", "name", "source", "level", F.lower("school").alias("school"), F.concat(size.cast("string"), F.when(size % 2 == 0, " minutes").otherwise(" hours")).alias("casting_time"),
        F.when(size % 3 == 0, "instant").alias("duration"), F.split("name", " ").alias("classes"), (size % 2 == 0).alias("verbal"), (size % 5 == 0).alias("somatic"), (size % 7 == 0).alias("ritual"),
        F.lit(None).cast("boolean").alias("concentration"), F.when(size > 40, "more each level").alias("upcast"), F.when(size % 4 == 0, "a gem, 1,000 GP").when(size % 4 == 1, "dust").alias("materials"),
        F.when(size % 6 == 0, "see elsewhere").alias("hint"), F.concat(F.lit("A "), F.col("name")).alias("description"), F.lit(None).cast("string").alias("stat_block"), (F.col("p_partkey") % 10 == 0).alias("prepared"),
    )


@query(f"""WITH x AS (SELECT *, {_has('gear')} AS gear, list_contains(string_split(lower(p_name), ' '), 'red') AS red FROM part)
 SELECT p_partkey FROM x WHERE (p_size % 4 = 0 OR contains(lower(p_name), '$$')) AND NOT (p_size % 7 = 0 OR contains(lower(p_name), 'ritual'))
 OR (lower(p_type) = 'promo' OR contains(lower(p_name), 'promo')) AND (red OR contains(lower(p_name), 'red') OR lower(p_type) = 'red') OR (p_size > 40 OR contains(lower(p_name), 'upcast')) AND (p_size % 6 = 0 OR contains(lower(p_name), '#else'))
 OR (p_partkey % 10 = 0 OR contains(lower(p_name), 'prepared')) AND (lower(p_brand) = 'brand#12' OR contains(lower(p_name), ':brand#12')) OR gear AND p_size % 9 = 0 AND false""")
def dsl_levelled(spark, sf_dir):
    """Costly materials, classes, schools, upcasts, hints, prepared names and sources of the first dialect."""
    return search(levelled_entries(spark, sf_dir), "$$,!ritual|promo,red|upcast,#else|prepared,:Brand#12", LEVELLED).select("p_partkey")


@query("""SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), '$blue') OR contains(lower(o_orderpriority), 'ritual') OR o_orderstatus = 'P' OR (o_custkey % 50 = 0)
 OR (o_totalprice > 100000 AND EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = o_orderkey AND contains(lower(p_name), 'blue')))""")
def dsl_arcane(spark, sf_dir):
    """Orders as entries of the second kind: components, arcana and flags."""
    none = F.lit(None).cast("string")
    rows = orders_with_components(spark, sf_dir).select(
        "o_orderkey", F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "P", "Ritual").otherwise("Nature").alias("arcanum"), F.lit("Petty").alias("power_level"), none.alias("distance"), none.alias("duration"),
        none.alias("casting_time"), (F.col("o_totalprice") > 100000).alias("combat"), (F.col("o_custkey") % 50 == 0).alias("reaction"), "components", *[none.alias(c) for c in ("brief", "effect", "crit_success", "crit_fail", "extra")],
    )
    return search(rows, "combat,$Blue|RITUAL|reaction", ARCANE).select("o_orderkey")


@query(f"""SELECT p_partkey FROM part WHERE (p_size % 4 = 0 OR {_has('reflex')}) AND NOT (p_size BETWEEN 10 AND 20 OR {_has('l10-20')}) OR (lower(p_type) = 'economy' OR {_has('economy')}) AND (contains(lower(p_brand), '#2') OR {_has('$#2')})
 OR regexp_matches(p_name, '(^|\\W)anvil($|\\W)', 'i')""")
def dsl_traited(spark, sf_dir):
    """Saves, levels, traditions, a text of components and full text of the third dialect."""
    size, none = F.col("level"), F.lit(None).cast("string")
    rows = parts(spark, sf_dir).select(
        "p_partkey", "name", "level", none.alias("range"), none.alias("area"), none.alias("duration"), none.alias("casting_time"), F.array(F.lit("x"), none).alias("tags"), F.array("school").alias("traditions"),
        F.when(size % 4 == 0, "basic Reflex").alias("save"), F.col("source").alias("components"), F.col("name").alias("description"), none.alias("reaction"), none.alias("summary"),
    )
    return search(rows, "REFLEX,!L10-20|economy,$#2|//anvil", TRAITED).select("p_partkey")


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'licen') OR contains(lower(source), '/licen')")
def dsl_fulltext_infix(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), "/Licen", Dialect(name="source", texts=("text",))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|\\W)the($|\\W)', 'i') OR contains(lower(source), '//the')")
def dsl_fulltext_word(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), "//the", Dialect(name="source", texts=("text",))).select("doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic <> 0, false) AND NOT contains(source, 'toxic')")
def dsl_negated_null(spark, sf_dir):
    """A missing flag is false, so its negation holds."""
    return search(texts(spark, sf_dir), "!toxic", TEXTS).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount <> 0")
def dsl_flag_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("").alias("line"), (F.col("l_returnflag") == "R").alias("returned"), F.col("l_discount").alias("discounted"))
    return search(rows, "returned,discounted", LINES).select("l_orderkey", "l_linenumber")


def orders_with_components(spark, sf_dir):
    """Orders with their lines as components; an order has a few lines."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    each = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(F.col("p_name").alias("display"), (F.col("l_returnflag") == "R").alias("consumed"))).alias("components"))
    return table(spark, sf_dir, "orders").join(each, "o_orderkey", "left")


@query("""SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), '$blue') OR o_orderkey IN
 (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(lower(p_name), 'blue'))""")
def dsl_any_component(spark, sf_dir):
    """Orders one of whose lines has a component like that; lines are filtered by part
    before they meet the orders."""
    component = table(spark, sf_dir, "part").where(infix(F.col("p_name"), "Blue")).select(F.col("p_partkey").alias("l_partkey"))
    lines = table(spark, sf_dir, "lineitem").join(component, "l_partkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"))
    return search_with_members(table(spark, sf_dir, "orders"), "$Blue", Dialect(name="o_orderpriority", source=None, exact=("o_orderstatus",)), lines, "o_orderkey").select("o_orderkey")


@query(f"""SELECT p_partkey, 'warm' AS list FROM part WHERE {_has('red')} AND NOT {_has('ring')} AND (p_size BETWEEN 1 AND 20)
 UNION ALL SELECT p_partkey, 'anvil' FROM part WHERE {_has('anvil')} UNION ALL SELECT p_partkey, 'all' FROM part""")
def percolate_lists(spark, sf_dir):
    """All saved queries against all rows in one scan."""
    lists = {"warm": "red,!ring;L1-20", "anvil": parse_query("anvil"), "all": []}
    return saved_queries(parts(spark, sf_dir), lists, PARTS).select("p_partkey", "list")


@query(f"SELECT p_partkey FROM part WHERE p_size BETWEEN 1 AND 3 OR {_has('l1-3')} OR p_name IN ('red widget', 'blue gear')")
def list_inclusion(spark, sf_dir):
    rows = parts(spark, sf_dir)
    return rows.where(included(rows, "L1-3", ["red widget", "blue gear"], PARTS)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name IN ('red widget', 'green gear')")
def prepared_semi(spark, sf_dir):
    names = spark.createDataFrame([("red widget",), ("green gear",), ("red widget",)], "name string")
    return prepared_rows(parts(spark, sf_dir), names).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE p_name = 'red widget' OR {_has('prepared')}")
def prepared_flag(spark, sf_dir):
    rows = parts(spark, sf_dir).withColumn("is_prepared", F.col("name") == "red widget")
    return search(rows, "prepared", Dialect(prepared="is_prepared")).select("p_partkey")


@query(f"SELECT p_partkey FROM part WHERE {_has('red')}")
def stream_search(spark, sf_dir):
    """The search over a stream of files, run until they are all read."""
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_name", "name")
    from tomewright.operators.shared import shared_folder

    source = shared_folder(spark)
    rows.write.parquet(source)
    out = searched_stream(spark, source, spark.read.parquet(source).schema, "red", Dialect(source=None)).select("p_partkey")
    return drained(out, shared_folder(spark), shared_folder(spark))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n_events FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    """All hourly windows of the event stream, the last ones too."""
    from tomewright.operators.shared import shared_folder

    source = shared_folder(spark)
    table(spark, sf_dir, "events").write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    counts = windowed_counts(events, "ts", "event_type").select(F.col("window.start").alias("start"), "event_type", "n_events")
    return drained(counts, shared_folder(spark), shared_folder(spark), mode="complete").withColumn("start", F.col("start").cast("timestamp_ntz"))
