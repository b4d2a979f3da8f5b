"""A sorted view kept as ranges: rows that come or go touch only their ranges.

A view is stored as folders of rows, each a range of the sort keys with the place
of every row in it, and an index with the first key, the size and the folder of
each range. New rows find their range by the stored bounds; the ranges that get
some are merged and written anew, all others stay as they are, and the place of
their rows follows from the sizes before them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomewright.operators.shared import partitions, written
from tomewright.sources.versions import Version, folders, latest, publish

#: Ranges of a view: its index is read by the driver and sent with each change.
MOST = 4096


class RangeView:
    """A view at ``root`` in the ascending order of the columns that ``keys`` names;
    these should end in a unique one. Descending order takes a negated column."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str]):
        self.spark, self.root, self.keys = spark, root, keys

    def _key(self) -> Column:
        return F.struct(*[F.col(f"`{k}`") for k in self.keys])

    def _index(self) -> tuple[DataFrame, Version]:
        now = latest(self.spark, self.root)
        if now is None:
            raise ValueError(f"no view at {self.root}")
        return self.spark.read.parquet(f"{self.root}/{now.folder}"), now

    def _publish(self, index: DataFrame, schema: str, number: int) -> Version:
        folder = f"index/{uuid.uuid4().hex}"
        index.select("range", "first", "n", "folder").coalesce(1).write.parquet(f"{self.root}/{folder}")
        return publish(self.spark, self.root, number, folder, schema)

    def _write(self, placed: DataFrame) -> DataFrame:
        """Write rows with range and place; (range, first, n, folder) of what is there."""
        folder = f"data/{uuid.uuid4().hex}"
        placed.write.partitionBy("range").parquet(f"{self.root}/{folder}")
        some = any(n.startswith("range=") for n in folders(self.spark, f"{self.root}/{folder}"))
        there = self.spark.read.parquet(f"{self.root}/{folder}") if some else placed.limit(0)
        sizes = there.groupBy("range").agg(F.min(self._key()).alias("first"), F.count(F.lit(1)).alias("n"))
        return sizes.withColumn("folder", F.concat(F.lit(f"{folder}/range="), F.col("range").cast("string")))

    def build(self, rows: DataFrame, rows_per_range: int = 100_000) -> Version:
        """Replace the view by ``rows``: one sort of all of them."""
        now = latest(self.spark, self.root)
        n = rows.count()
        parts = max(1, min(MOST, -(-n // rows_per_range)))
        dealt = rows.repartitionByRange(parts, *[F.col(f"`{k}`") for k in self.keys]) if n else rows.coalesce(1)
        local = written(dealt.withColumn("range", F.spark_partition_id()))
        place = F.row_number().over(Window.partitionBy("range").orderBy(*[F.col(f"`{k}`") for k in self.keys])).cast("long")
        index = self._write(local.repartition(parts, "range").withColumn("place", place))
        if not n:  # a view without rows has no bounds yet
            index = self.spark.createDataFrame([], index.schema)
        return self._publish(index, json.dumps(json.loads(rows.schema.json())), (now.number if now else 0) + 1)

    def read(self) -> DataFrame:
        """The rows with their ``place`` from 1 in the whole view."""
        index, now = self._index()
        schema = StructType.fromJson(json.loads(now.note))
        ranges = index.select("range", "first", "n", "folder").collect()  # MOST rows, and twice that after changes
        if not ranges:
            return self.spark.createDataFrame([], schema.add("place", "long"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = F.broadcast(index.select(F.col("folder").alias("_folder"), before.alias("_before")))
        paths = [f"{self.root}/{r.folder}" for r in ranges]
        rows = self.spark.read.schema(schema.add("place", "long")).parquet(*paths)
        own = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]+/range=[0-9]+)/[^/]*$", 1)
        met = rows.withColumn("_folder", own).join(starts, "_folder")
        return met.withColumn("place", F.col("place") + F.col("_before")).drop("_folder", "_before")

    def _bounded(self, rows: DataFrame, index: DataFrame) -> DataFrame:
        """``rows`` with the number of the range each belongs to: the last one whose
        first key is not above its own, or the first range of all."""
        bounds = index.agg(F.array_sort(F.collect_list(F.struct("first", "range"))).alias("_bounds"))
        at = F.size(F.filter("_bounds", lambda b: b["first"] <= self._key()))
        place = F.element_at("_bounds", F.greatest(at, F.lit(1)))["range"]
        return rows.crossJoin(F.broadcast(bounds)).withColumn("range", place.cast("int")).drop("_bounds")

    def _replaced(self, rows: DataFrame, touched: list[int], index: DataFrame, now: Version) -> Version:
        """Write ``rows`` (with range), all that the ranges ``touched`` hold now."""
        place = F.row_number().over(Window.partitionBy("range").orderBy(*[F.col(f"`{k}`") for k in self.keys])).cast("long")
        new = self._write(rows.repartition(min(len(touched), partitions(self.spark)), "range").withColumn("place", place))
        return self._publish(index.where(~F.col("range").isin(touched)).unionByName(new), now.note, now.number + 1)

    def _stored(self, index: DataFrame, touched: list[int], now: Version) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.note))
        parts = index.where(F.col("range").isin(touched)).select("range", "folder").collect()
        rows = self.spark.read.schema(schema).parquet(*[f"{self.root}/{r.folder}" for r in parts])
        return rows.withColumn("range", F.regexp_extract(F.col("_metadata.file_path"), r"/range=([0-9]+)/[^/]*$", 1).cast("int"))

    def insert(self, new: DataFrame) -> list[int]:
        """Add rows; the numbers of the ranges that were written anew."""
        index, now = self._index()
        if index.isEmpty():
            self.build(new)
            return []
        dealt = written(self._bounded(new, index))
        touched = sorted(r["range"] for r in dealt.select("range").distinct().collect())
        if touched:
            stored = self._stored(index, touched, now)
            self._replaced(stored.unionByName(dealt.select(*stored.columns)), touched, index, now)
        return touched

    def delete(self, gone: Column) -> list[int]:
        """Take away the rows for which ``gone`` holds; the ranges that were written
        anew. All rows are looked at, but only ranges that lose some are written."""
        index, now = self._index()
        ranges = [r["range"] for r in index.select("range").collect()]
        if not ranges:
            return []
        all_ = self._stored(index, ranges, now)
        holds = F.coalesce(gone, F.lit(False))
        touched = sorted(r["range"] for r in all_.where(holds).select("range").distinct().collect())
        if touched:
            self._replaced(self._stored(index, touched, now).where(~holds), touched, index, now)
        return touched
