"""What a table of results shows, after rows come, go or are sorted anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.ranking import ranked
from tomewright.plans.search import Dialect, Query, search
from tomewright.plans.sorting import sort_order
from tomewright.sources.catalogue import partitions


def selected(spark: SparkSession, path: str, sources: list[str] | None, query: str | Query, d: Dialect) -> DataFrame:
    """The rows of some books of a written catalogue that a query matches; only
    the folders of these books are read."""
    return search(partitions(spark, path, sources), query, d)


def shown(rows: DataFrame, query: str | Query, d: Dialect, sorting: str | None, ties: list[str]) -> DataFrame:
    """All rows filtered and sorted anew, with their ``place`` from 1. ``ties`` should end in a key."""
    found = search(rows, query, d)
    return ranked(found, sort_order(sorting, d, [F.col(c) for c in ties], found), "place")


def inserted(view: DataFrame, new: DataFrame, query: str | Query, d: Dialect, sorting: str | None, ties: list[str]) -> DataFrame:
    """A view and those of the new rows that its query matches, in its order;
    among equals the new ones come first."""
    both = view.drop("place").withColumn("_old", F.lit(True)).unionByName(search(new, query, d).withColumn("_old", F.lit(False)))
    return ranked(both, sort_order(sorting, d, [F.col(c) for c in ("_old", *ties)], both), "place").drop("_old")


def deleted(view: DataFrame, gone: Column) -> DataFrame:
    """A view without the rows for which ``gone`` holds; a null holds for nothing."""
    return view.where(~F.coalesce(gone, F.lit(False)))


def toggled(view: DataFrame, rows: DataFrame, included: Column, everything: bool, query: str | Query, d: Dialect, sorting: str | None, ties: list[str]) -> DataFrame:
    """A view of included rows widened to all that its query matches, or narrowed
    to the included ones again."""
    if everything:
        return inserted(view, rows.where(~F.coalesce(included, F.lit(False))), query, d, sorting, ties)
    return deleted(view, ~F.coalesce(included, F.lit(False)))
