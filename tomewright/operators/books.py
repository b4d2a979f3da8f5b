"""Book names: loose matching to exactly one book, and rows of unknown books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import squeeze


def _keys(name: Column) -> Column:
    """The forms under which names agree: lower case; letters and white space
    only; other characters as spaces with runs of one character squeezed."""
    low = F.lower(name)
    return F.array(
        F.concat(F.lit("="), low), F.concat(F.lit("-"), F.regexp_replace(low, r"[^\p{L}\s]", "")), F.concat(F.lit("~"), squeeze(F.regexp_replace(low, r"[^\p{L}]", " ")))
    )


def resolve_books(names: DataFrame, books: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``shorthand`` and ``n_books``: the book that a name stands
    for, if exactly one does. ``books`` has shorthand, full_name and alts (array).

    An equi-join on every form of every name, so it costs no comparison of all
    names with all books."""
    titles = books.select("shorthand", F.explode(F.array_compact(F.concat(F.array("full_name"), F.coalesce("alts", F.array().cast("array<string>"))))).alias("title"))
    forms = titles.select("shorthand", F.explode(_keys(F.col("title"))).alias("form"))
    forms = forms.unionByName(books.select("shorthand", F.concat(F.lit("#"), F.lower("shorthand")).alias("form"))).distinct()
    distinct = names.select(F.col(name).alias("_name")).distinct()
    asked = distinct.select("_name", F.explode(F.concat(_keys(F.col("_name")), F.array(F.concat(F.lit("#"), F.lower("_name"))))).alias("form"))
    hits = asked.join(forms, "form").groupBy("_name").agg(F.count_distinct("shorthand").alias("n_books"), F.min("shorthand").alias("shorthand"))
    out = names.join(hits, names[name] == hits["_name"], "left").drop("_name")
    n = F.coalesce("n_books", F.lit(0)).cast("long")
    return out.withColumn("shorthand", F.when(n == 1, F.col("shorthand"))).withColumn("n_books", n)


def known_rows(rows: DataFrame, books: DataFrame, source: str = "source") -> DataFrame:
    return rows.join(books.select(F.col("shorthand").alias(source)), source, "left_semi")


def discarded_sources(rows: DataFrame, books: DataFrame, source: str = "source") -> DataFrame:
    """A row for each source without a book, with how many rows it loses."""
    lost = rows.join(books.select(F.col("shorthand").alias(source)), source, "left_anti")
    return lost.groupBy(source).agg(F.count(F.lit(1)).alias("n_rows"))


def book_counts(rows: DataFrame, books: DataFrame, source: str = "source") -> DataFrame:
    """Rows of every configured book, also of those without any."""
    counted = rows.groupBy(F.col(source).alias("shorthand")).agg(F.count(F.lit(1)).alias("n_rows"))
    return books.select("shorthand").join(counted, "shorthand", "left").fillna(0, ["n_rows"])


def with_titles(rows: DataFrame, books: DataFrame, source: str = "source") -> DataFrame:
    return rows.join(books.select(F.col("shorthand").alias(source), F.col("full_name").alias("book_title")), source)


def partition_counts(rows: DataFrame, source: str = "source", total: str = "total") -> DataFrame:
    """Rows of every book and of all together, in one pass."""
    return rows.rollup(source).agg(F.count(F.lit(1)).alias("n"), F.grouping(source).alias("_all")).select(F.when(F.col("_all") == 1, total).otherwise(F.col(source)).alias(source), "n")
