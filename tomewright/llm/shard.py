"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import Shared
from tomewright.llm.prefix import positions


#: The order of rows over all shards.
ORDER = ["doc_id", "text_crc32", "size"]


def _measured(overhead: int, id_col: str, text_col: str) -> list[Column]:
    raw = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    size = (F.octet_length(raw) + F.lit(overhead)).cast("long")
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32")]


def _placed(at: DataFrame, n_shards: int) -> DataFrame:
    """The shard in whose equal span of all bytes the middle of a row lies."""
    middle = (2 * F.col("sum_before") + F.col("size")).cast("decimal(38,0)") * n_shards / (2 * F.col("sum_all")).cast("decimal(38,0)")
    return at.withColumn("shard", F.least(F.floor(middle).cast("int"), F.lit(n_shards - 1)))


def shard_by_bytes(
    docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    In the order of doc_id (null first), row r starts at the sum of the sizes
    before it; the shard is the one of ``n_shards`` equal spans of the total in
    which the middle of r lies. So shards are contiguous, and each is within one
    document of its share. ``size`` is the text's UTF-8 bytes plus ``overhead``;
    a null text has none. ``slot`` counts from 0 in each shard in the same order.
    Rows with equal ids stand next to each other, ordered by checksum and size.
    An empty table gives no rows. Only id, size and checksum are shuffled, so a very
    long text is only measured; one that is longer than a shard's share leaves
    the next shards emptier, or empty.
    """
    sized = docs.select(*_measured(overhead, id_col, text_col))
    placed = _placed(positions(sized, ORDER, "size", Shared(docs.sparkSession)), n_shards)
    first = placed.groupBy("shard").agg(F.min("row_before").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row_before") - F.col("first_row")).alias("slot")
    )


def write_shards(
    docs: DataFrame, path: str, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard"
) -> None:
    """Write the rows of ``docs`` as they are, one folder ``shard=k`` for each shard.

    Rows get their shard by ``shard_by_bytes``'s rule, each for itself and without a join: null
    and repeated ids, and equal rows, are written as often as they stand. One
    range shuffle of whole rows, after which a task holds a stretch of one shard
    or two. A column named ``shard_col`` in ``docs`` is an error.
    """
    if shard_col in docs.columns:
        raise ValueError(f"there is a column {shard_col!r} already")
    shared = Shared(docs.sparkSession)
    rows = docs.select(*_measured(overhead, id_col, text_col), F.struct("*").alias("row"))
    placed = _placed(positions(rows, ORDER, "size", shared), n_shards)
    placed = placed.sortWithinPartitions("shard", "row_before").select("row.*", F.col("shard").alias(shard_col))
    placed.write.partitionBy(shard_col).parquet(path)
    shared.only()
