"""Catalogues of typed records in JSON or Parquet, and pages and search hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.functions.text import links, slug

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


def read(spark: SparkSession, kind: str, allowed: set[str] | None = None, **options) -> DataFrame:
    """The rows of a configured source; an unknown or barred kind is an error."""
    if kind not in READERS or (allowed is not None and kind not in allowed):
        raise ValueError(f"no source of type {kind!r}")
    return READERS[kind](spark, **options)


@reader("copy")
def typed_json(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Files that hold arrays of records; null entries are skipped, other shapes
    fail the read."""
    kind = T.ArrayType(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
    each = spark.read.text(paths, wholetext=True).select(F.explode(F.from_json("value", kind, {"mode": "FAILFAST"})).alias("r"))
    return each.where("r is not null").select("r.*")


@reader("partitions")
def partitions(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """A written catalogue; ``sources`` reads only those partitions, in all a bag."""
    rows = spark.read.parquet(path)
    return rows if sources is None else rows.where(F.col("source").isin(sources))


@reader("text")
def whole_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, text) of each file, for document sources."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def list_or_one(raw: Column) -> Column:
    """A JSON array of strings, or one string as an array of one."""
    several = F.from_json(raw, "array<string>")
    one = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
    return F.when(F.ltrim(raw).startswith("["), several).otherwise(F.array_compact(F.array(one)))


def page_entries(pages: DataFrame, part: str, html: str = "html") -> DataFrame:
    """A row for each linked entry of list pages, with the slug its page has."""
    rows = pages.select("page_id", F.posexplode(links(F.col(html), part)).alias("place", "entry"))
    return rows.withColumn("slug", slug(F.col("entry")))


def page_layout(html: Column) -> Column:
    """Title, heading and body text of an entry page. ``ok`` is false where the
    page has not one heading inside an article; such pages are rejects."""
    title = F.regexp_extract(html, "(?s)<title>([^<]*)</title>", 1)
    article = F.regexp_extract(html, "(?s)<article>(.*)</article>", 1)
    headings = F.regexp_extract_all(article, F.lit("(?s)<h1>([^<]*)</h1>"), F.lit(1))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(article, "(?s)<h1>[^<]*</h1>", ""), "<[^>]*>", " "), r"[ \t\r\n]+", " ")
    return F.struct((F.size(headings) == 1).alias("ok"), title.alias("title"), F.get(headings, F.lit(0)).alias("heading"), F.trim(body).alias("body"))


def search_hits(raw: DataFrame, book: str) -> DataFrame:
    """Rows of stored search hits for one book. The stored match is loose, so the
    book is compared again, ignoring case; superseded records are left out."""
    return raw.where((F.lower("primary_source") == book.lower()) & F.col("legacy_id").isNull() & F.col("remaster_id").isNull())


#: Fixed value: where a reference names its page.
PAGE = r"pg\.\s*([0-9]+)\s*$"


def hit_record(components: Column, page: Column) -> tuple[Column, Column]:
    """Components joined by commas, and the page number at the end of a reference."""
    n = F.regexp_extract(page, PAGE, 1)
    return F.array_join(F.coalesce(components, F.array().cast("array<string>")), ", "), F.when(n != "", n).try_cast("int")


def default_sources(index: list[str], asked: list[str] | None, most: int = 3) -> list[str]:
    """The books to load: the only one, those asked for in any case, else the first few."""
    if len(index) == 1:
        return index
    if asked:
        return [x for x in index if x in {a.upper() for a in asked}]
    return index[:most]
