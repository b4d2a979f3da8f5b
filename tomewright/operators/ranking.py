"""A rank over a whole sorted table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.quantity import sort_columns
from tomewright.operators.shared import looked_up, written


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in ``order``, which should end in a key and
    whose keys should be columns, not computations.

    One range shuffle; each range numbers its own rows, and the row counts of the
    ranges (one row for each) give every range its start.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the range, the lower 33 the place in it
    local = written(sorted_.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = local.groupBy("_part").count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    out = local.join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_start") + 1).drop("_part", "_id", "_start")


def ranked_by_value(df: DataFrame, value: Column, text: str, key: str, name: str = "rank") -> DataFrame:
    """(``key``, place): valid values first by size, then the rest by text. ``value``
    follows from ``text`` alone and is computed once for each distinct text; only
    it, the text and the key are shuffled."""
    known = written(df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_read", value))
    rows = written(looked_up(df.select(key, text), text, known, known.count()))
    keys = sort_columns("_read", text)
    order = [F.col(k).asc_nulls_last() for k in keys]
    return ranked(rows.select(key, *[c.alias(k) for k, c in keys.items()]), [*order, F.col(key)], name).select(key, name)
