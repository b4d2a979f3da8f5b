"""A searched view that follows files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tomewright.plans.search import Dialect, search


def searched_stream(spark: SparkSession, path: str, schema: StructType, query: str, d: Dialect) -> DataFrame:
    """Rows of new Parquet files under ``path`` that match the query."""
    return search(spark.readStream.schema(schema).parquet(path), query, d)


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events in fixed windows; rows later than ``late`` are dropped from state."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n_events"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run until all present files are read; the rows written to ``path``. In
    ``complete`` mode each batch replaces them by all rows so far; none is late."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start().awaitTermination()
    else:
        writer.format("parquet").start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
