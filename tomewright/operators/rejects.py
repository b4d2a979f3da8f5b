"""Rows that can be read and rows that can't, with the reason, from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.operators.shared import written


def judged(rows: DataFrame, checks: list[tuple[Column | str, Column]], silent: Column | None = None) -> DataFrame:
    """``rows`` with ``reason``: the first of ``checks`` (reason, what must hold) that
    fails, null for good rows. An unknown outcome fails. Rows for which ``silent``
    holds are no records at all and left out."""
    fails = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(why) if isinstance(why, str) else F.coalesce(why, F.lit("unknown"))) for why, ok in checks]
    some = rows if silent is None else rows.where(~F.coalesce(silent, F.lit(False)))
    return some.withColumn("reason", F.coalesce(*fails, F.lit(None).cast("string")))


def routed(rows: DataFrame, checks: list[tuple[Column | str, Column]], silent: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with reason). What ``rows`` take to compute is computed
    once: both are read from one written table, so they never disagree."""
    all_ = written(judged(rows, checks, silent))
    return all_.where("reason is null").drop("reason"), all_.where("reason is not null")
