"""Sums of prices that may be unknown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price_sums(components: DataFrame, by: str, price: str = "price", consumed: str = "consumed", display: str = "display") -> DataFrame:
    """For each ``by`` the known sum and the unknown names of what is consumed and
    of what persists. Unknown names keep repeats, sorted."""
    known = lambda c: F.coalesce(F.sum(F.when(c, F.col(price))), F.lit(0.0))
    unknown = lambda c: F.array_sort(F.collect_list(F.when(c & F.col(price).isNull(), F.col(display))))
    used = F.coalesce(F.col(consumed), F.lit(False))
    return components.groupBy(by).agg(
        known(used).alias("consumed_sum"), unknown(used).alias("consumed_unknown"), known(~used).alias("kept_sum"), unknown(~used).alias("kept_unknown")
    )


def cost_totals(sums: DataFrame, casts: Column) -> DataFrame:
    """Totals over a cost sheet: casts, entries cast at all, what persists once
    for each entry that is cast, and what is consumed times its casts."""
    n = F.greatest(F.coalesce(casts, F.lit(0)), F.lit(0))
    cast = n > 0
    return sums.agg(
        F.sum(n).cast("long").alias("n_casts"),
        F.count_if(cast).alias("n_cast_entries"),
        F.sum(F.when(cast, F.col("kept_sum")).otherwise(0.0)).alias("kept_total"),
        F.sum(F.when(cast, F.col("consumed_sum") * n).otherwise(0.0)).alias("consumed_total"),
        F.sum(F.when(cast, F.size("kept_unknown") + F.size("consumed_unknown")).otherwise(0)).cast("long").alias("n_unknown"),
    )
