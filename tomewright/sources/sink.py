"""Writing catalogues: a partition for each book, content tags and an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import content_tag
from tomewright.operators.books import book_counts, known_rows
from tomewright.sources.snapshot import dealt_by_book


def record_json(df: DataFrame) -> Column:
    """The row as JSON with all its nulls."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def write_catalogue(rows: DataFrame, books: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Replace the catalogue at ``path``: rows of configured books by source, a file
    for each book, or for each ``rows_per_file`` rows of a large one."""
    sizes = book_counts(rows, books).select(F.col("shorthand").alias("source"), "n_rows").where("n_rows > 0")
    dealt_by_book(rows, sizes, rows_per_file).drop("n_rows", "_deal").write.mode("overwrite").partitionBy("source").parquet(path)


def manifest(rows: DataFrame, books: DataFrame) -> DataFrame:
    """shorthand, full_name, tag and n_rows of every configured book, also empty
    ones. The tag follows the content: it is made of the rows' digests, each of
    which is summed, so that no partition is gathered in one place."""
    coded = known_rows(rows, books).select("source", F.conv(F.substring(F.md5(record_json(rows)), 1, 15), 16, 10).cast("decimal(38,0)").alias("d"))
    tags = coded.groupBy(F.col("source").alias("shorthand")).agg(content_tag(F.sum("d").cast("string")).alias("tag"))
    return books.select("shorthand", "full_name").join(book_counts(rows, books), "shorthand").join(tags, "shorthand", "left")


def index_json(manifest_rows: DataFrame, game: str) -> DataFrame:
    """One JSON text: game to book to title and tag. One row for each book."""
    each = F.map_from_entries(F.array_sort(F.collect_list(F.struct("shorthand", F.struct(F.col("full_name").alias("title"), "tag")))))
    return manifest_rows.agg(F.to_json(F.create_map(F.lit(game), each)).alias("index"))
