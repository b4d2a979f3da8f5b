"""Tables and pages of documents, made from orders and parts in many shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.levels import split_at_base
from tomewright.functions.text import first_index, indices_where, split_first
from tomewright.operators.pages import entry_pages
from tomewright.operators.tables import material_rows, materials_of, read_rows, table_rows
from tomewright.operators.shared import partitions, shared_folder
from tomewright.queries import query, table
from tomewright.queries.costs import units
from tomewright.sources.texts import entries, learned, read_sources, sources_of, with_macros


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order, a row for each of its lines: materials with units,
    declarations of variants, variants, and rows with groups and a broken unit."""
    line = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kind, n, price = F.col("l_partkey") % 4, F.col("l_quantity").cast("int").cast("string"), F.col("p_size").cast("string")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    text = (
        F.when(kind == 0, say(F.col("p_name"), r" & a {\bf pack} of \grUnit{", n, " [g]} & ", price, r" \Cu "))
        .when(kind == 1, say(r"\grDeclareVariants{small/v", F.col("l_linenumber").cast("string"), "} & & "))
        .when(kind == 2, say(r"{\it ", F.col("p_name"), r"} & \grVariants{1 \Cu / ", price, r" \Ag} & "))
        .otherwise(say(F.col("p_name"), r" {a & b \\ c} & \grUnit{", n, r" [kg} & 1 \Cu"))
    )
    each = line.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("text")))).alias("lines"))
    return each.select("table_id", F.array_join("lines.text", r"\\").alias("body"))


_LINES = """x AS (SELECT l_orderkey AS table_id, l_linenumber, l_partkey % 4 AS kind, p_name, CAST(l_quantity AS INT) AS n, p_size, max(CASE WHEN l_partkey % 4 = 1 THEN l_linenumber END)
 OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS declared FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _read(spark, sf_dir):
    return material_rows(read_rows(table_rows(order_tables(spark, sf_dir))), units(spark))


@query(f"""WITH {_LINES} SELECT table_id, p_name AS name, n::BIGINT AS amount_number, 'g' AS amount_unit, p_size::BIGINT AS copper FROM x WHERE kind = 0
 UNION ALL SELECT table_id, 'small ' || p_name, 1, '1', 1 FROM x WHERE kind = 2 AND declared IS NOT NULL UNION ALL SELECT table_id, 'v' || declared || ' ' || p_name, 1, '1', 36 * p_size FROM x WHERE kind = 2 AND declared IS NOT NULL""")
def material_tables(spark, sf_dir):
    """What the rows of all tables define; variants come from the declaration before."""
    return materials_of(_read(spark, sf_dir)[0], ["table_id"]).drop("row")


@query(f"""WITH {_LINES} SELECT table_id, CASE WHEN kind = 3 THEN 'bad amount' ELSE 'variants without declaration' END AS reason, count(*) AS n FROM x
 WHERE kind = 3 OR (kind = 2 AND declared IS NULL) GROUP BY ALL""")
def material_table_rejects(spark, sf_dir):
    return _read(spark, sf_dir)[1].groupBy("table_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT p_partkey, i, substr(t, i, 1) AS c FROM (SELECT p_partkey, replace(p_name, 'e', '{, e}') || ',' || p_brand || '{' || repeat('{,', p_size % 3) || repeat(',}', p_size % 3) || '},' AS t FROM part), range(1, 200) r(i) WHERE i <= length(t)),
 d AS (SELECT *, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS depth FROM c),
 g AS (SELECT *, sum(CASE WHEN c = ',' AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey ORDER BY i) AS part FROM d)
 SELECT p_partkey, part::INT AS place, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE NOT (c = ',' AND depth = 0)), '') AS piece FROM g GROUP BY ALL""")
def level_aware_split(spark, sf_dir):
    """Texts with groups of several levels, cut at the commas of the base level."""
    deep = (F.col("p_size") % 3).cast("int")
    text = F.concat(F.replace("p_name", F.lit("e"), F.lit("{, e}")), F.lit(","), "p_brand", F.lit("{"), F.repeat(F.lit("{,"), deep), F.repeat(F.lit(",}"), deep), F.lit("},"))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(split_at_base(text, ",")).alias("place", "piece"))


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as wiki pages, some of which break the layout in one place or another. The
    parts are spread first: a part is some bytes of a file, so few tasks would read it,
    and its page is some hundreds and takes long to parse."""
    k, size = F.col("p_partkey"), F.col("p_size")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    n, odd = size.cast("string"), k % 23
    level = F.when(size % 4 == 0, "Illusion cantrip").otherwise(say(n, "th-level evocation", F.when(size % 3 == 0, " (ritual)").otherwise("")))
    lines = say(
        "<strong>Casting Time:</strong> ", n, " minutes", F.when(size % 5 == 0, ", when hit").otherwise(""), "<br/><strong>Range:</strong> ", F.when(size % 2 == 0, "Self (30 feet)").otherwise("Touch"),
        "<br />\n<strong>Components:</strong> V", F.when(size % 2 == 0, say(", M (a ", F.col("p_name"), ")")).otherwise(", S"), F.when(odd == 5, "").otherwise("<br><b>Duration:</b> "),
        F.when(size % 3 == 0, "Concentration, up to ").otherwise(""), n, " hours",
    )
    html = say(
        '<html><head><title>x</title></head><body><div id="page-content"><div>', n, "</div><p>Source: ", F.when(odd == 3, "").otherwise("Book "), F.col("p_brand"), " / more</p><p><em>", F.when(odd == 4, "no level").otherwise(level), "</em></p><p>", lines,
        "</p><p>About <b>", F.col("p_name"), "</b></p>", F.when(size % 3 == 1, say("<ul><li>", n, "</li></ul>")).otherwise(""), F.when(size % 6 == 0, say("<p><strong>At Higher Levels.</strong> more ", n, "</p>")).otherwise(""),
        F.when(odd == 6, "").otherwise("<p><strong>Spell Lists.</strong> Bard, Mage</p>"), F.when(size % 7 == 0, say("<table><tr><td>", n, "</td></tr></table>")).otherwise(""), F.when(odd == 7, "<p>end</p>").otherwise("<div>end</div>"), "</div></body></html>",
    )
    each = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size").repartition(partitions(spark), "p_partkey")
    return each.select(k.alias("page_id"), html.alias("html"))


@query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 23 = 3 THEN '' ELSE 'Book ' END || p_brand AS book, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END::INT AS level, CASE WHEN p_size % 4 = 0 THEN 'illusion' ELSE 'evocation' END AS school,
 p_size % 4 <> 0 AND p_size % 3 = 0 AS ritual, p_size || ' minutes' AS casting_time, CASE WHEN p_size % 5 = 0 THEN 'when hit' END AS reaction, CASE WHEN p_size % 2 = 0 THEN 'Self' ELSE 'Touch' END AS range,
 CASE WHEN p_size % 2 = 0 THEN 'a ' || p_name END AS materials, p_size % 3 = 0 AS concentration, p_size || ' hours' AS duration,
 '<p>About <b>' || p_name || '</b></p>' || CASE WHEN p_size % 3 = 1 THEN chr(10) || '<ul><li>' || p_size || '</li></ul>' ELSE '' END AS description,
 CASE WHEN p_size % 6 = 0 THEN '<p>more ' || p_size || '</p>' END AS upcast, 2 AS n_classes, CASE WHEN p_size % 7 = 0 THEN '<table><tr><td>' || p_size || '</td></tr></table>' END AS stat_block
 FROM part WHERE p_partkey % 23 NOT IN (4, 5, 6, 7)""")
def wiki_entries(spark, sf_dir):
    """The fields of pages that keep the layout."""
    entries, _ = entry_pages(wiki_pages(spark, sf_dir))
    return entries.withColumn("n_classes", F.size("classes")).drop("classes", "verbal", "somatic")


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 23 WHEN 4 THEN 'bad level' WHEN 5 THEN 'expected 4 lines' WHEN 6 THEN 'expected class list' ELSE 'bad page-content makeup' END AS reason
 FROM part WHERE p_partkey % 23 IN (4, 5, 6, 7)""")
def wiki_rejects(spark, sf_dir):
    return entry_pages(wiki_pages(spark, sf_dir))[1]


@query("SELECT doc_id, source AS book, 'in ' || lang || ' of the' || source || CASE WHEN doc_id % 4 = 0 THEN ' {x}' ELSE '' END AS body FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0")
def text_sources(spark, sf_dir):
    """Files of entries by book, half of them listed in a manifest, with macros that use
    each other and take the blanks after them; entries without a body are rejects, marked ones are none."""
    docs, path = table(spark, sf_dir, "documents"), shared_folder(spark)
    k = F.col("doc_id")
    line = F.concat(
        F.lit("\\entry{"), k.cast("string"), F.lit("}"),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit(" \\inlang "), "lang", F.lit(" \\sep "), "source", F.when(k % 4 == 0, " {x}").otherwise(""), F.when(k % 9 == 0, " \\notanentry").otherwise(""))),
    )
    name = F.concat("source", F.lit("-"), (k % 2).cast("string"))
    docs.select(line.alias("value"), name.alias("file")).repartition("file").write.partitionBy("file").text(f"{path}/texts")
    macros = spark.createDataFrame([(r"% macros \newcommand{\sep}{of \art }" + "\n" + r"\newcommand\art{a}\renewcommand{\art}{the}  \newcommand{\inlang}{in }",)], "value string")
    macros.coalesce(1).write.text(f"{path}/macros")
    listed = docs.select(F.col("source").alias("book"), F.concat(F.lit(f"{path}/texts/file="), name).alias("file")).distinct()
    manifest = listed.groupBy("book").agg(F.collect_list("file").alias("files"))
    files = manifest.where("size(files) > 1").select("book", F.slice("files", 1, 1).alias("files")).unionByName(spark.createDataFrame([("macros", [f"{path}/macros"])], "book string, files array<string>"))
    documents, macro_files = read_sources(spark, sources_of(files, manifest))
    good, _ = entries(with_macros(documents, learned(macro_files)), "entry", silent="notanentry")
    return good.select(F.col("name").cast("long").alias("doc_id"), "book", "body")


_BARE = r"^[\s\x0B\x{85}\p{Z}]+|[\s\x0B\x{85}\p{Z}]+\z"


@query(f"""SELECT doc_id, regexp_replace(CASE WHEN place > 0 THEN left(text, place - 1) ELSE text END, '{_BARE}', '', 'g') AS head,
 CASE WHEN place > 0 THEN regexp_replace(substr(text, place + 2), '{_BARE}', '', 'g') END AS tail FROM (SELECT doc_id, text, instr(text, '. ') AS place FROM documents)""")
def first_sentence(spark, sf_dir):
    """Each whole text at its first full stop before a space."""
    halves = split_first(F.col("text"), ". ")
    return table(spark, sf_dir, "documents").select("doc_id", halves["left"].alias("head"), halves["right"].alias("tail"))


@query("""SELECT doc_id, list_filter(range(len(w)), lambda i: length(w[i + 1]) >= 9) AS places,
 CASE WHEN w IS NOT NULL THEN coalesce(list_filter(range(len(w)), lambda i: length(w[i + 1]) >= 9)[1], -1) END::INT AS first_place
 FROM (SELECT doc_id, string_split_regex(text, '[ \n]') AS w FROM documents)""")
def long_word_places(spark, sf_dir):
    """The places of the words of nine or more characters in each whole text."""
    words, long = F.split("text", "[ \n]"), lambda w: F.length(w) >= 9
    return table(spark, sf_dir, "documents").select("doc_id", indices_where(words, long).alias("places"), first_index(words, long).alias("first_place"))
