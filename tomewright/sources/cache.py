"""A keyed memo kept as a Parquet snapshot. Entries may carry a digest of what they
hold; those that don't fit theirs are damaged and count as missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(columns: list[str]):
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(columns)]), {"ignoreNullFields": "false"}))


def sealed(entries: DataFrame) -> DataFrame:
    """Entries with the digest of all their columns but the time."""
    held = [c for c in entries.columns if c not in ("stored_at", "digest")]
    return entries.withColumn("digest", _digest(held))


def damaged(cache: DataFrame) -> DataFrame:
    """Entries of a sealed cache that don't fit their digest, or have none."""
    held = [c for c in cache.columns if c not in ("stored_at", "digest")]
    return cache.where(~F.coalesce(F.col("digest") == _digest(held), F.lit(False)))


def intact(cache: DataFrame) -> DataFrame:
    held = [c for c in cache.columns if c not in ("stored_at", "digest")]
    return cache.where(F.col("digest") == _digest(held))


def repaired(wanted: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], **age) -> DataFrame:
    """``refreshed`` for a sealed cache: damaged entries are computed anew, and what
    comes out is sealed."""
    return sealed(refreshed(wanted, intact(cache).drop("digest"), key, compute, **age))


def misses(wanted: DataFrame, cache: DataFrame, key: str, max_age_s: float | None = None, now=None) -> DataFrame:
    """Wanted keys without an entry, or with one that is too old."""
    fresh = cache if max_age_s is None else cache.where(F.unix_timestamp(F.current_timestamp() if now is None else now) - F.unix_timestamp("stored_at") <= max_age_s)
    return wanted.select(key).distinct().join(fresh, key, "left_anti")


def unused(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return cache.select(key).join(wanted, key, "left_anti")


def refreshed(wanted: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], **age) -> DataFrame:
    """The next snapshot: kept entries still wanted, and computed ones for the
    misses. Keys for which nothing is computed stay misses."""
    lost = misses(wanted, cache, key, **age)
    kept = cache.join(wanted.select(key).distinct(), key, "left_semi").join(lost, key, "left_anti")
    return kept.unionByName(compute(lost).withColumn("stored_at", F.current_timestamp()))
