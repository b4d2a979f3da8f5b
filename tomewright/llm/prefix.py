"""Global row numbers and running sums without a single-task window.

Rows are dealt into key ranges, each range counts for itself, and the few range
totals give every range its start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.common import Shared, partitions


def _running(weight: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            w = b.column(b.schema.get_field_index(weight)).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(w, dtype=np.int64)
            n = len(w)
            extra = {"part": np.full(n, part, np.int32), "row_before": np.arange(rows, rows + n), "sum_before": ends - w}
            rows, total = rows + n, int(ends[-1]) if n else total
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra.values())], names=[*b.schema.names, *extra])

    return run


def positions(df: DataFrame, order: list[str], weight: str, shared: Shared) -> DataFrame:
    """``df`` with ``row_before`` and ``sum_before``: how many rows, and how much
    weight, come earlier in the order of the columns ``order``; and ``rows_all``
    and ``sum_all``, the totals. Rows equal in all of ``order`` stand in any
    order. ``weight`` is a long column without nulls.

    One range shuffle of these columns; the table of range totals has a row for
    each partition, which bounds what is broadcast.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int, row_before long, sum_before long"
    # equal rows are spread over ranges too, as the last key is unique
    keyed = df.withColumn("tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(partitions(df.sparkSession), *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    local = shared.keep(dealt.mapInArrow(_running(weight), schema))
    ends = local.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = ends.select(
        "part",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in "nw"],
        F.sum("n").over(whole).alias("rows_all"),
        F.sum("w").over(whole).alias("sum_all"),
    )
    return (
        local.join(F.broadcast(start), "part")
        .withColumn("row_before", F.col("row_before") + F.col("n_start"))
        .withColumn("sum_before", F.col("sum_before") + F.col("w_start"))
        .drop("part", "n_start", "w_start")
    )
