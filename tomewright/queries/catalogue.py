"""Scans, sinks, books, caches and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.cards import cells
from tomewright.functions.text import content_tag, entry_url, html_encode, key_values, links, markdown_inline, markdown_lines, natural_join, ordinal, slug, squeeze, strip_tags, unwrap_links
from tomewright.functions.text import latex_plain as plain_latex
from tomewright.operators.books import book_counts, discarded_sources, known_rows, partition_counts, resolve_books, with_titles
from tomewright.operators.lists import all_hold, merged
from tomewright.operators.shared import shared_folder
from tomewright.queries import query, table
from tomewright.queries.searching import parts
from tomewright.sources.cache import misses, refreshed, repaired, sealed, unused
from tomewright.sources.catalogue import default_sources, hit_record, list_or_one, page_entries, page_layout, partitions, search_hits
from tomewright.sources.sink import manifest, record_json, write_catalogue


def books(spark: SparkSession, n: int = 12) -> DataFrame:
    """Books src0, src2, ... and one that has no rows."""
    rows = [(f"src{2 * i}", f"Book {i}") for i in range(n)] + [("none", "Empty Book")]
    return spark.createDataFrame(rows, "shorthand string, full_name string")


_BOOKS = "(SELECT 'src' || 2 * i AS shorthand, 'Book ' || i AS full_name FROM range(12) t(i) UNION ALL SELECT 'none', 'Empty Book')"


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src5')")
def scan_union_sources(spark, sf_dir):
    """Some partitions of a written catalogue, as a bag."""
    docs, path = table(spark, sf_dir, "documents"), shared_folder(spark)
    docs.select("doc_id", "source").repartition("source").write.partitionBy("source").parquet(path)
    return partitions(spark, path, ["src1", "src5"]).select("doc_id", "source")


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM documents")
def index_counts(spark, sf_dir):
    return partition_counts(table(spark, sf_dir, "documents"))


@query(f"SELECT doc_id FROM documents WHERE source IN (SELECT shorthand FROM {_BOOKS})")
def discard_unknown(spark, sf_dir):
    return known_rows(table(spark, sf_dir, "documents"), books(spark)).select("doc_id")


@query(f"SELECT source, count(*) AS n_rows FROM documents WHERE source NOT IN (SELECT shorthand FROM {_BOOKS}) GROUP BY ALL")
def reject_report(spark, sf_dir):
    return discarded_sources(table(spark, sf_dir, "documents"), books(spark))


@query(f"SELECT shorthand, count(doc_id) AS n_rows FROM {_BOOKS} LEFT JOIN documents ON source = shorthand GROUP BY ALL")
def empty_books(spark, sf_dir):
    """A count for every configured book, also for those without rows."""
    return book_counts(table(spark, sf_dir, "documents"), books(spark))


@query(f"SELECT shorthand, full_name, count(doc_id) AS n_rows, count(doc_id) > 0 AS tagged FROM {_BOOKS} LEFT JOIN documents ON source = shorthand GROUP BY ALL")
def manifest_index(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return manifest(rows, books(spark)).select("shorthand", "full_name", "n_rows", F.coalesce(F.col("tag").rlike("^[0-9A-F]{6}$"), F.lit(False)).alias("tagged"))


@query(f"SELECT source, count(*) AS n FROM documents WHERE source IN (SELECT shorthand FROM {_BOOKS}) GROUP BY ALL")
def partitioned_write(spark, sf_dir):
    path = shared_folder(spark)
    write_catalogue(table(spark, sf_dir, "documents").select("doc_id", "source"), books(spark), path)
    return partitions(spark, path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, upper(md5(text)[:6]) AS tag FROM documents")
def content_tags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_tag(F.col("text")).alias("tag"))


@query("""SELECT doc_id, '{"doc_id":' || doc_id || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null') || '}' AS json FROM documents LEFT JOIN labels USING (doc_id)""")
def null_keeping_json(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", record_json(rows).alias("json"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN [event_type] ELSE [event_type, 'x'] END AS tags FROM events")
def scalar_or_list(spark, sf_dir):
    kind = F.col("event_type")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"'), kind, F.lit('"'))).otherwise(F.concat(F.lit('["'), kind, F.lit('", "x"]')))
    return table(spark, sf_dir, "events").select("event_id", list_or_one(raw).alias("tags"))


@query("SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src10')")
def default_partitions(spark, sf_dir):
    """Without a choice, the first three books in index order."""
    chosen = default_sources(sorted(f"src{i}" for i in range(20)), None)
    return table(spark, sf_dir, "documents").where(F.col("source").isin(chosen)).select("doc_id")


@query("SELECT p_partkey, p_name AS name FROM part WHERE lower(p_name) = 'blue gear' AND p_brand = (SELECT min(p_brand) FROM part WHERE lower(p_name) = 'blue gear') ORDER BY p_partkey LIMIT 1")
def lookup_first(spark, sf_dir):
    """The first row of one source with a name; the limit is the feature."""
    rows = parts(spark, sf_dir).where(F.lower("name") == "blue gear")
    return rows.orderBy("source", "p_partkey").limit(1).select("p_partkey", "name")


@query("SELECT source AS key, list_sort(list(DISTINCT lang)) AS values FROM documents GROUP BY ALL")
def manifest_merge(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id", F.array("lang").alias("values"))
    return merged(docs.where("doc_id % 2 = 0").drop("doc_id"), docs.where("doc_id % 2 = 1").drop("doc_id"))


@query("SELECT p_partkey FROM part WHERE p_brand = 'Brand#12' AND p_size % 7 <> 0 AND p_size % 11 <> 0")
def residual_filter(spark, sf_dir):
    """Search hits of one book, ignoring case, without superseded records."""
    raw = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_brand").alias("primary_source"), F.when(F.col("p_size") % 7 == 0, "old").alias("legacy_id"), F.when(F.col("p_size") % 11 == 0, "new").alias("remaster_id"))
    return search_hits(raw, "brand#12").select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type || ', ' || p_brand END AS components, CASE WHEN p_size % 2 = 0 THEN p_size END AS page FROM part")
def hit_records(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    size = F.col("p_size")
    listed = F.when(size % 3 != 0, F.array("p_type", "p_brand"))
    reference = F.concat(F.lit("Book pg. "), size.cast("string"), F.when(size % 2 == 0, " ").otherwise(" ff"))
    components, page = hit_record(listed, reference)
    return rows.select("p_partkey", components.alias("components"), page.alias("page"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def keyed_cache_misses(spark, sf_dir):
    return misses(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id >= 100)")
def cache_expired(spark, sf_dir):
    """Entries of 200 seconds are too old where 100 are allowed."""
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    age = F.when(F.col("doc_id") < 100, 200).otherwise(50)
    cache = table(spark, sf_dir, "labels").withColumn("stored_at", F.timestamp_seconds(F.unix_timestamp(now) - age))
    return misses(table(spark, sf_dir, "documents"), cache, "doc_id", 100, now)


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def cache_unused(spark, sf_dir):
    return unused(table(spark, sf_dir, "documents").where("lang = 'en'"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN l.doc_id % 10 = 0 OR l.doc_id IS NULL THEN -1 ELSE quality END::INT AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_repaired(spark, sf_dir):
    """A sealed cache in which each tenth entry was changed: these are computed anew,
    like the missing ones."""
    good = sealed(table(spark, sf_dir, "labels").select("doc_id", "quality", F.current_timestamp().alias("stored_at")))
    hurt = good.withColumn("quality", F.when(F.col("doc_id") % 10 == 0, F.coalesce("quality", F.lit(0)) + 5).otherwise(F.col("quality")))
    return repaired(table(spark, sf_dir, "documents"), hurt, "doc_id", lambda k: k.withColumn("quality", F.lit(-1))).select("doc_id", "quality")


@query("SELECT doc_id, coalesce(quality, -1)::INT AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def cache_refreshed(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id", "quality", F.current_timestamp().alias("stored_at"))
    return refreshed(table(spark, sf_dir, "documents"), cache, "doc_id", lambda k: k.withColumn("quality", F.lit(-1))).select("doc_id", "quality")




@query("""WITH b AS (SELECT 'n' || n_nationkey AS shorthand, n_name AS title FROM nation), k AS (SELECT shorthand, lower(title) AS t FROM b),
 f AS (SELECT shorthand, '=' || t AS form FROM k UNION SELECT shorthand, '-' || regexp_replace(t, '[^a-z\\s]', '', 'g') FROM k UNION
 SELECT shorthand, '~' || list_reduce(list_prepend('', string_split(regexp_replace(t, '[^a-z]', ' ', 'g'), '')), lambda a, c: CASE WHEN a[-1] = c THEN a ELSE a || c END) FROM k UNION SELECT shorthand, '#' || lower(shorthand) FROM b),
 n AS (SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN n_name || '!' WHEN 2 THEN 'N' || n_nationkey ELSE 'no such' END AS name FROM nation),
 a AS (SELECT n_nationkey, unnest(['=' || lower(name), '-' || regexp_replace(lower(name), '[^a-z\\s]', '', 'g'),
 '~' || list_reduce(list_prepend('', string_split(regexp_replace(lower(name), '[^a-z]', ' ', 'g'), '')), lambda a, c: CASE WHEN a[-1] = c THEN a ELSE a || c END), '#' || lower(name)]) AS form FROM n),
 h AS (SELECT n_nationkey, count(DISTINCT shorthand) AS n_books, min(shorthand) AS s FROM a JOIN f USING (form) GROUP BY ALL)
 SELECT n_nationkey, name, CASE WHEN n_books = 1 THEN s END AS shorthand, coalesce(n_books, 0) AS n_books FROM n LEFT JOIN h USING (n_nationkey)""")
def resolve_book_fuzzy(spark, sf_dir):
    """Names in other case, with punctuation, as shorthands, and unknown ones."""
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    known = nation.select(F.concat(F.lit("n"), key.cast("string")).alias("shorthand"), F.col("n_name").alias("full_name"), F.array().cast("array<string>").alias("alts"))
    name = F.when(key % 4 == 0, F.upper("n_name")).when(key % 4 == 1, F.concat("n_name", F.lit("!"))).when(key % 4 == 2, F.concat(F.lit("N"), key.cast("string"))).otherwise("no such")
    return resolve_books(nation.select("n_nationkey", name.alias("name")), known)


@query(f"SELECT doc_id, full_name AS book_title FROM documents JOIN {_BOOKS} ON source = shorthand")
def book_title_lookup(spark, sf_dir):
    return with_titles(table(spark, sf_dir, "documents"), books(spark)).select("doc_id", "book_title")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?i)</?a(\\s[^>]*)?>', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS html FROM pages")
def html_unwrap_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", unwrap_links(F.col("html")).alias("html"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def strip_html_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@query("""WITH x AS (SELECT page_id, unnest(list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href="[^"]*/[^"]*"[^>]*>([^<]*)</a>', 1), lambda x: trim(x)), lambda x: NOT ends_with(x, ')'))) AS entry,
 generate_subscripts(list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href="[^"]*/[^"]*"[^>]*>([^<]*)</a>', 1), lambda x: trim(x)), lambda x: NOT ends_with(x, ')')), 1) - 1 AS place FROM pages)
 SELECT page_id, CAST(place AS INT) AS place, entry, lower(regexp_replace(regexp_replace(entry, '[ /:]', '-', 'g'), '[^\\x00-\\x7E]|''', '', 'g')) AS slug FROM x""")
def link_list(spark, sf_dir):
    return page_entries(table(spark, sf_dir, "pages"), "/")


@query("SELECT p_partkey, replace(lower(regexp_replace(p_name || '/' || p_brand || ': X''s', '[ /:]', '-', 'g')), chr(39), '') AS slug FROM part")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", slug(F.concat("p_name", F.lit("/"), "p_brand", F.lit(": X's"))).alias("slug"))


_ENC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"""SELECT doc_id, list_reduce(list_prepend({_ENC.format('text')}, list_transform(range(160, 256), lambda i: chr(CAST(i AS INT)))),
 lambda a, c: replace(a, c, '&#' || ord(c) || ';')) AS html FROM documents""")
def html_encoded(spark, sf_dir):
    """Every text, those with Latin-1 letters too."""
    return table(spark, sf_dir, "documents").select("doc_id", html_encode(F.col("text")).alias("html"))


def _sql_inline(x: str) -> str:
    """Inline marks in SQL, whose expressions know no back references: one mark after the other."""
    for pattern, into in (
        (r"\[([^\]\[]*)\]\([^()]*\)", r"\1"),
        (r"\*\*(.+?)\*\*", r"<strong>\1</strong>"),
        (r"__(.+?)__", r"<strong>\1</strong>"),
        (r"\*(.+?)\*", r"<em>\1</em>"),
        (r"_(.+?)_", r"<em>\1</em>"),
        (r"\\([\\*_\[\]()#!-])", r"\1"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{into}', 'g')"
    return x


@query(f"SELECT doc_id, {_sql_inline('text')} AS html FROM documents")
def markdown_inlines(spark, sf_dir):
    """Every text, those with stars, underscores and escapes too."""
    return table(spark, sf_dir, "documents").select("doc_id", markdown_inline(F.col("text")).alias("html"))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
 k AS (SELECT *, regexp_extract(x, '^(#{{1,6}}) +(.*)$', 1) AS head, trim(regexp_extract(x, '^(#{{1,6}}) +(.*)$', 2)) AS title,
 regexp_extract(x, '^[ \t]*(?:[*-]|[1-9][0-9]*\.) +(.*)$', 1) AS item FROM l),
 h AS (SELECT doc_id, i, CASE WHEN trim(x) = '' THEN '' WHEN regexp_matches(x, '^-{{3,}}[ \t]*$') THEN '<hr/>'
 WHEN head <> '' THEN '<h' || length(head) || '>' || {_sql_inline('title')} || '</h' || length(head) || '>'
 WHEN item <> '' THEN '<ul><li>' || {_sql_inline('item')} || '</li></ul>'
 ELSE '<p>' || {_sql_inline('trim(x)')} || CASE WHEN ends_with(x, '  ') THEN '<br/>' ELSE '' END || '</p>' END AS y FROM k),
 t AS (SELECT doc_id, string_agg(y, '' ORDER BY i) AS html FROM h GROUP BY doc_id)
 SELECT doc_id, html FROM documents LEFT JOIN t USING (doc_id)""")
def markdown_html(spark, sf_dir):
    """Every text, those with rules, headings, lists, links and emphasis too."""
    return table(spark, sf_dir, "documents").select("doc_id", markdown_lines(F.col("text")).alias("html"))


@query(r"""SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)(^|[^\\])%.*$', '\1', 'g'),
 '\\[A-Za-z0-9]+[ \t]*', '', 'g'), '\\([{}%&$#_])', '\1', 'g'), '[{}$]', '', 'g'), '[ \t]+', ' ', 'g'), chr(10), '') AS text FROM documents""")
def latex_plain_text(spark, sf_dir):
    """Every text, those with macros too."""
    return table(spark, sf_dir, "documents").select("doc_id", plain_latex(F.col("text")).alias("text"))


@query("SELECT p_partkey, p_size || CASE CASE WHEN p_size <= 20 THEN p_size ELSE p_size % 10 END WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd' ELSE 'th' END || '-level ' || p_type AS title FROM part")
def ordinal_level(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(ordinal(F.col("p_size")), F.lit("-level "), "p_type").alias("title"))


@query("""SELECT n_regionkey, CASE len(l) WHEN 1 THEN l[1] WHEN 2 THEN l[1] || ' and ' || l[2] ELSE array_to_string(l[:-2], ', ') || ', and ' || l[-1] END AS names
 FROM (SELECT n_regionkey, list(n_name ORDER BY n_name) AS l FROM nation GROUP BY ALL)""")
def natural_joins(spark, sf_dir):
    """Names of nations as prose; a region has a few."""
    each = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return each.select("n_regionkey", natural_join(F.col("l")).alias("names"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(chr(10), CASE WHEN l_returnflag <> '' THEN 'flag: ' || l_returnflag END, CASE WHEN l_linestatus = 'O' THEN 'status: O' END) AS lines FROM lineitem")
def key_value_lines(spark, sf_dir):
    status = F.when(F.col("l_linestatus") == "O", "O").otherwise("")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", key_values([("flag", F.col("l_returnflag")), ("status", status), ("none", F.lit(None).cast("string"))]).alias("lines"))


@query("""SELECT doc_id, lang, CASE WHEN coalesce(toxic, 0) <> 0 THEN 'Yes' ELSE 'No' END AS toxic, coalesce(CAST(quality AS VARCHAR), '') AS quality, source || ',' || lang AS tags FROM documents LEFT JOIN labels USING (doc_id)""")
def table_projection(spark, sf_dir):
    """Flags as words, missing values as nothing, lists joined by commas."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.withColumn("toxic", F.col("toxic") != 0).withColumn("tags", F.array("source", "lang"))
    return rows.select("doc_id", *cells(rows, ["lang", "toxic", "quality", "tags"]))


@query("SELECT p_partkey, 'details.html?name=' || replace(replace(url_encode(p_name), '+', '%20'), '*', '*') || '&from=' || url_encode(p_brand) AS url FROM part")
def url_build(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", entry_url(F.col("p_name"), F.col("p_brand")).alias("url"))


@query("SELECT p_type AS school, bool_and(p_size < 50) AS all_small FROM part GROUP BY ALL UNION ALL SELECT 'none', true")
def all_prepared(spark, sf_dir):
    """Whether a predicate holds for all rows; for no rows it does."""
    rows = parts(spark, sf_dir)
    each = rows.groupBy("school").agg(all_hold(F.col("level") < 50).alias("all_small"))
    return each.unionByName(rows.where("level > 1000").agg(all_hold(F.col("level") < 0).alias("all_small")).select(F.lit("none").alias("school"), "all_small"))


@query("SELECT DISTINCT source FROM documents WHERE lang = 'en' UNION SELECT DISTINCT source FROM documents WHERE lang = 'fr'")
def union_distinct(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.where("lang = 'en'").select("source").union(docs.where("lang = 'fr'").select("source")).distinct()


@query("SELECT page_id, len(list_filter(list_transform(regexp_extract_all(html, '<a [^>]*href=\"[^\"]*http[^\"]*\"[^>]*>([^<]*)</a>', 1), lambda x: trim(x)), lambda x: NOT ends_with(x, ')'))) AS n_links FROM pages")
def link_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(links(F.col("html"), "http")).cast("long").alias("n_links"))


@query("SELECT DISTINCT p_name AS name, list_reduce(list_prepend('', string_split(p_name, '')), lambda a, c: CASE WHEN a[-1] = c THEN a ELSE a || c END) AS squeezed FROM part")
def squeeze_chars(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("squeezed", squeeze(F.col("name")))


@query("""WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) AS article FROM pages),
 h AS (SELECT *, regexp_extract_all(article, '(?s)<h1>([^<]*)</h1>', 1) AS hs FROM a)
 SELECT page_id, len(hs) = 1 AS ok, title, hs[1] AS heading, trim(regexp_replace(regexp_replace(regexp_replace(article, '(?s)<h1>[^<]*</h1>', '', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS body FROM h""")
def page_layouts(spark, sf_dir):
    """The fields of entry pages."""
    return table(spark, sf_dir, "pages").select("page_id", page_layout(F.col("html")).alias("x")).select("page_id", "x.*")
