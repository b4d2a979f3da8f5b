"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that one task may gather in any case.
OFTEN = 256


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Only where that setting is
    absent (tests on one machine) a local folder is made, and kept in the session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tomewright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/tables/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written there and read again: its lineage ends, lost executors cost
    nothing, and each later use sees the same rows."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def looked_up(df: DataFrame, key: str, lookup: DataFrame, rows: int, parts: int = 1000) -> DataFrame:
    """``df``, of about ``rows`` rows, left-joined with ``lookup``, which has a row for
    each of some values of ``key``. Values with more than one in ``parts`` of the rows,
    of which there can be no more than ``parts``, are broadcast, so no task gathers
    them; null keys match nothing and are not moved. ``df`` is read three times."""
    new = [c for c in lookup.columns if c != key]
    nothing = {c: F.lit(None).cast(lookup.schema[c].dataType) for c in new}
    some = df.where(F.col(key).isNotNull())
    often = some.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(OFTEN, rows // parts)).select(key)
    often = F.broadcast(often.join(lookup, key, "left"))
    rest = some.join(often.select(key), key, "left_anti").join(lookup, key, "left")
    out = some.join(often, key).unionByName(rest).unionByName(df.where(F.col(key).isNull()).withColumns(nothing))
    return out.select(*df.columns, *new)
