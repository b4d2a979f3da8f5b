"""Ordered rows: segments, runs, groups between separators, labels before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Each anchor with ``until``, the place of the next one, null for the last."""
    return rows.withColumn("until", F.lead(order).over(Window.partitionBy(by).orderBy(order)))


def squeezed(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Without rows whose value equals that of the row before."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_b", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where(~F.col("_b").eqNullSafe(F.col(value)) | (F.col("_n") == 1)).drop("_b", "_n")


def groups_between(rows: DataFrame, by: str, order: list[str], separator: Column) -> DataFrame:
    """Rows that are no separators, with ``group``: how many separators stand before."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_s", separator).withColumn("group", F.sum(F.col("_s").cast("long")).over(w)).where("not _s").drop("_s")


def last_label(rows: DataFrame, by: str, order: list[str], label: Column, name: str = "label") -> DataFrame:
    """The last non-null label strictly before each row."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(label, ignorenulls=True).over(w))


def discriminators(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """1, 2, ... within each ``by``; null where it has one row only."""
    w = Window.partitionBy(by)
    n = F.row_number().over(w.orderBy(*order))
    return rows.withColumn("discriminator", F.when(F.count(F.lit(1)).over(w) > 1, n))


def last_set(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """The last value of each ``by`` that is not empty."""
    return rows.where(F.col(value) != "").groupBy(by).agg(F.max_by(value, order).alias(value))
