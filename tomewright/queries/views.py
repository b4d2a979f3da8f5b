"""Views that rows are added to and taken from, and parsers of stored markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tomewright.functions.parsing import component_cost, label_arcanum
from tomewright.functions.text import after_rule, find_window, split_by, tags_as_html
from tomewright.operators import views
from tomewright.operators.rangeview import RangeView
from tomewright.operators.shared import shared_folder
from tomewright.queries import query, table
from tomewright.queries.searching import PARTS, TEXTS, parts
from tomewright.sources.catalogue import typed_json, whole_texts

_RED = "contains(lower(p_name), 'red')"
_TIES = ["name", "p_partkey"]


@query("SELECT doc_id FROM documents WHERE source IN ('src1', 'src5') AND (contains(lower(source), 'en') OR lang ILIKE 'en')")
def select_sources_query(spark, sf_dir):
    """A search over some books of a written catalogue."""
    path = shared_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit(0).alias("toxic"), F.lit(0).alias("quality"), "text")
    docs.repartition("source").write.partitionBy("source").parquet(path)
    return views.selected(spark, path, ["src1", "src5"], "en", TEXTS).select("doc_id")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS place FROM part WHERE {_RED}")
def view_refilter(spark, sf_dir):
    return views.shown(parts(spark, sf_dir), "red", PARTS, "level", _TIES).select("p_partkey", "place")


@query(f"SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey % 2 = 0, p_name, p_partkey) AS place FROM part WHERE {_RED}")
def view_insert(spark, sf_dir):
    """Rows of even keys are shown; those of odd keys come in, before their equals."""
    rows = parts(spark, sf_dir)
    view = views.shown(rows.where("p_partkey % 2 = 0"), "red", PARTS, "-level", _TIES)
    return views.inserted(view, rows.where("p_partkey % 2 = 1"), "red", PARTS, "-level", _TIES).select("p_partkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_name, p_partkey) AS place FROM part WHERE p_partkey % 3 <> 0 OR p_size = 7")
def view_delta(spark, sf_dir):
    """A view stored in ranges: two thirds of the rows, then the rest of one level
    comes in, which touches the ranges of that level only."""
    rows = table(spark, sf_dir, "part").select("p_size", "p_name", "p_partkey")
    view = RangeView(spark, shared_folder(spark), ["p_size", "p_name", "p_partkey"])
    view.build(rows.where("p_partkey % 3 <> 0"), rows_per_range=500)
    view.insert(rows.where("p_partkey % 3 = 0 and p_size = 7"))
    return view.read().select("p_partkey", "place")


@query("SELECT p_partkey, row_number() OVER (ORDER BY -p_size, p_partkey) AS place FROM part WHERE NOT p_size BETWEEN 10 AND 12")
def view_delta_delete(spark, sf_dir):
    """Rows of three levels go from a stored view in descending order."""
    rows = table(spark, sf_dir, "part").select((-F.col("p_size")).alias("down"), "p_partkey")
    view = RangeView(spark, shared_folder(spark), ["down", "p_partkey"])
    view.build(rows, rows_per_range=500)
    view.delete(F.col("down").between(-12, -10))
    return view.read().select("p_partkey", "place")


@query(f"SELECT p_partkey FROM part WHERE {_RED} AND NOT p_size > 20")
def view_delete(spark, sf_dir):
    view = views.shown(parts(spark, sf_dir), "red", PARTS, None, _TIES)
    return views.deleted(view, F.col("level") > 20).select("p_partkey")


@query(f"SELECT p_partkey, 'on' AS state FROM part WHERE {_RED} UNION ALL SELECT p_partkey, 'off' FROM part WHERE {_RED} AND p_size <= 20")
def view_toggle(spark, sf_dir):
    """All rows that the query matches, then the included ones again."""
    rows, included = parts(spark, sf_dir), F.col("level") <= 20
    view = views.shown(rows.where(included), "red", PARTS, None, _TIES)
    on = views.toggled(view, rows, included, True, "red", PARTS, None, _TIES)
    off = views.toggled(on, rows, included, False, "red", PARTS, None, _TIES)
    return on.select("p_partkey", F.lit("on").alias("state")).union(off.select("p_partkey", F.lit("off").alias("state")))


@query("""SELECT p_partkey, p_size % 4 <> 3 AS ok, '<h4>' || p_name || '</h4>' || CASE p_size % 4 WHEN 0 THEN '<img src="/img/' || p_type || '.png" />' WHEN 1 THEN '<br/>' || p_brand WHEN 2 THEN '<ul><li>x</li></ul>' ELSE '<blink>' END AS html FROM part""")
def tag_markup(spark, sf_dir):
    m = F.col("p_size") % 4
    more = F.when(m == 0, F.concat(F.lit('<actions string="'), "p_type", F.lit('" />'))).when(m == 1, F.concat(F.lit("<row>"), "p_brand", F.lit("</row>"))).when(m == 2, "<ul><li>x</li></ul>").otherwise("<blink>")
    text = F.concat(F.lit('<document><title level="'), F.col("p_size").cast("string"), F.lit('">'), "p_name", F.lit("</title>"), more)
    return table(spark, sf_dir, "part").select("p_partkey", tags_as_html(text).alias("x")).select("p_partkey", "x.*")


@query("SELECT doc_id, CASE WHEN contains(text, '---') THEN substr(text, strpos(text, '---') + 3) END AS body FROM documents")
def body_after_rule(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", after_rule(F.col("text")).alias("body"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)[^\pL\pN]th(?s:.)n') THEN CAST(length(regexp_extract(text, '(?is)^(.*?)[^\pL\pN]th.n', 1)) + 1 AS INT) END AS "at" FROM documents""")
def window_match(spark, sf_dir):
    """Where words first begin with th, anything and n."""
    return table(spark, sf_dir, "documents").select("doc_id", find_window(F.col("text"), [("#", "th.n", "")])["at"].alias("at"))


@query("SELECT p_partkey, CASE WHEN ends_with(p_type, 'e') THEN string_split(p_type, 'e')[:-2] ELSE string_split(p_type, 'e') END AS groups FROM part")
def splitby_trailing(spark, sf_dir):
    """Letters between e's; an empty last group does not count."""
    each = split_by(F.filter(F.split("p_type", ""), lambda x: x != ""), lambda x: x == "e")
    return table(spark, sf_dir, "part").select("p_partkey", F.transform(each, lambda x: F.array_join(x, "")).alias("groups"))


@query("""SELECT p_partkey, p_name AS display, p_size % 2 = 0 AS consumed, CASE WHEN p_size % 5 = 0 THEN 'FORAGE' ELSE 'MISC' END AS tag,
 CASE WHEN p_size % 3 = 0 THEN 36 * p_size WHEN p_size % 5 = 0 THEN 0 END::BIGINT AS price FROM part""")
def component_hints(spark, sf_dir):
    n = F.col("p_size")
    hint = F.when(n % 3 == 0, F.concat(F.lit("\\grPrice{"), n.cast("string"), F.lit(" \\Ag}"))).when(n % 7 == 0, "\\grPrice").otherwise("")
    text = F.concat("p_name", F.when(n % 2 == 0, " \\Consumed").otherwise(""), F.when(n % 5 == 0, " \\Forage.").otherwise("."), hint)
    return table(spark, sf_dir, "part").select("p_partkey", component_cost(text).alias("x")).select("p_partkey", "x.display", "x.consumed", "x.tag", "x.price")


@query("""SELECT p_partkey, p_size % 5 <> 4 AS ok, p_size % 5 <> 0 AS is_row, CASE p_size % 5 WHEN 1 THEN 'Ritual' WHEN 2 THEN 'Divine' WHEN 3 THEN 'Celestial' END AS arcanum FROM part""")
def arcanum_labels(spark, sf_dir):
    m = F.col("p_size") % 5
    label = F.when(m == 0, "arc:x").when(m == 1, "rit:x").when(m == 2, "a:div:b").when(m == 3, "a:star:b").otherwise("a:none:b")
    return table(spark, sf_dir, "part").select("p_partkey", label_arcanum(label).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, p_name FROM part WHERE p_size % 3 <> 0")
def json_copy(spark, sf_dir):
    """Records copied from files that hold arrays of them, without null entries."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 1000).alias("file"), F.when(F.col("p_size") % 3 != 0, F.struct("p_partkey", "p_name")).alias("r"))
    entries = F.array_join(F.collect_list(F.coalesce(F.to_json("r"), F.lit("null"))), ",")
    rows.groupBy("file").agg(F.concat(F.lit("["), entries, F.lit("]")).alias("value")).write.partitionBy("file").text(path)
    return typed_json(spark, f"{path}/file=*", "p_partkey long, p_name string").select("p_partkey", "p_name")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n_lines FROM documents GROUP BY ALL")
def text_files(spark, sf_dir):
    """Lines of written text files, read whole."""
    path = shared_folder(spark)
    table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("value")).repartition("source").write.partitionBy("source").text(path)
    read = whole_texts(spark, f"{path}/source=*")
    n = F.regexp_count("text", F.lit("\n"))
    return read.groupBy(F.regexp_extract("file", "source=([^/]*)", 1).alias("source")).agg(F.sum(n).cast("long").alias("n_lines"))
