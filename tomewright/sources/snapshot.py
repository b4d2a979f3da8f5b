"""Catalogues by content: files named by book and tag, found through an index.

A write computes a digest for each book and compares it with the index of the
version before. Only books whose digest differs are written, under a name that
the digest is part of, so files are never changed; then the next index is
published. A read takes its files from the index and opens no others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomewright.operators.shared import partitions, written
from tomewright.sources.versions import folders, latest, publish, remove

#: What an index holds for each book.
INDEX = "shorthand string, full_name string, tag string, digest string, n_rows long, file string"


def row_digests(columns: list[str]) -> tuple[Column, Column]:
    """Two numbers of 60 bits of a row: their sums over rows in any order, with the
    count, name a bag of rows."""
    code = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"}))
    half = lambda at: F.conv(F.substring(code, at, 15), 16, 10).cast("decimal(38,0)")
    return half(1), half(17)


def digests(rows: DataFrame, books: DataFrame) -> DataFrame:
    """INDEX for each configured book, also one without rows; rows of other books
    are left out. Sums are made before the shuffle, so no book is gathered."""
    a, b = row_digests(sorted(rows.columns))
    sums = rows.select("source", a.alias("a"), b.alias("b")).groupBy(F.col("source").alias("shorthand"))
    sums = sums.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    every = books.select("shorthand", "full_name").join(sums, "shorthand", "left").fillna(0, ["n_rows"])
    digest = F.upper(F.md5(F.concat_ws(" ", "shorthand", "n_rows", F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string"))))
    named = every.withColumn("digest", digest).withColumn("tag", F.left("digest", F.lit(6)))
    file = F.concat(F.regexp_replace("shorthand", "[^A-Za-z0-9_.-]", "_"), F.lit("-"), "digest")
    return named.select("shorthand", "full_name", "tag", "digest", "n_rows", file.alias("file"))


def dealt_by_book(rows: DataFrame, sizes: DataFrame, rows_per_file: int) -> DataFrame:
    """``rows`` of the books in ``sizes(source, n_rows, ..)``, each in one task, or in
    several of about ``rows_per_file`` rows; so books make no more files than that,
    and a large one keeps many tasks busy. ``sizes`` has a row for each book of the
    configuration, which Spark broadcasts if it is small."""
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.ceil(F.col("n_rows") / rows_per_file))
    return rows.join(sizes, "source").withColumn("_deal", deal).repartition(partitions(rows.sparkSession), "source", "_deal")


def current_index(spark: SparkSession, path: str) -> DataFrame | None:
    now = latest(spark, path)
    return spark.read.schema(INDEX).parquet(f"{path}/{now.folder}") if now else None


def write_snapshot(rows: DataFrame, books: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Publish ``rows`` (with a column source) of ``books`` as the next version at
    ``path``; the index, with ``written``: whether the book's file is new."""
    spark = rows.sparkSession
    now, before = latest(spark, path), current_index(spark, path)
    schema = json.dumps(json.loads(rows.schema.json()))
    new = digests(rows, books)
    if before is None or now.note != schema:
        new = new.withColumn("written", F.lit(True))
    else:
        known = before.select("shorthand", "digest", F.lit(True).alias("known"))
        new = new.join(known, ["shorthand", "digest"], "left").withColumn("written", F.col("known").isNull()).drop("known")
    new = written(new)
    changed = new.where("written").select(F.col("shorthand").alias("source"), "n_rows", "file")
    there = set(folders(spark, f"{path}/data"))
    for r in changed.select("file", "n_rows").collect():  # a row for each changed book
        if f"file={r.file}" in there:  # left by a write that was never published, or of an older version
            remove(spark, f"{path}/data/file={r.file}")
        if not r.n_rows:
            spark.createDataFrame([], rows.schema).coalesce(1).write.parquet(f"{path}/data/file={r.file}")
    if not changed.where("n_rows > 0").isEmpty():
        dealt_by_book(rows, changed, rows_per_file).drop("n_rows", "_deal").write.mode("append").partitionBy("file").parquet(f"{path}/data")
    folder = f"index/{uuid.uuid4().hex}"
    new.drop("written").coalesce(1).write.parquet(f"{path}/{folder}")
    publish(spark, path, (now.number if now else 0) + 1, folder, schema)
    return new


def read_snapshot(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """The rows of the newest version, of ``sources`` if given, in all a bag. The
    index decides which files are opened; an unknown book is an error."""
    now = latest(spark, path)
    if now is None:
        raise ValueError(f"no catalogue at {path}")
    index = {r.shorthand: r for r in current_index(spark, path).collect()}  # a row for each book
    if lost := sorted(set(sources or ()) - set(index)):
        raise ValueError(f"no book {lost[0]!r}")
    schema = StructType.fromJson(json.loads(now.note))
    found = [f"{path}/data/file={index[s].file}" for s in (index if sources is None else dict.fromkeys(sources))]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove the files that the newest index doesn't name."""
    kept = {f"file={r.file}" for r in current_index(spark, path).collect()}
    old = [n for n in folders(spark, f"{path}/data") if n.startswith("file=") and n not in kept]
    for name in old:
        remove(spark, f"{path}/data/{name}")
    return old
