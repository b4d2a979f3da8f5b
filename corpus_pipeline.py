"""A corpus pipeline: rules, near copies, repeated passages, personal data, batches.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again for the next one. All but the last return the columns of
``docs``. Rows go by id and text, so ids may repeat or be null; null texts and
equal rows are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.buckets import batches
from tomewright.llm.common import delete, shared_folder, table
from tomewright.llm.jaccard import without_near_copies
from tomewright.llm.pii import masked
from tomewright.llm.quality import quality
from tomewright.llm.repeats import without_repeats


def counted_again(docs: DataFrame) -> list[Column]:
    """The columns of ``docs``, with n_chars following the text."""
    return [F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality operator keeps; no join, no shuffle of texts."""
    judged = quality(docs, table(spark, sf_dir, "labels"), whole_rows=True)
    return judged.where("kept").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, 0.8) the smallest id."""
    return without_near_copies(docs, words=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 100 bytes or more that stand earlier; texts
    of which nothing is left go. A character that a cut splits goes with it."""
    return without_repeats(docs, length=100).select(*counted_again(docs))


def masked_identifiers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kind."""
    return masked(docs).select(*counted_again(docs))


def length_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document in batches of optimal length buckets."""
    return batches(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", one_of_near_copies),
    ("suffix-array dedup", without_repeated_passages),
    ("PII", masked_identifiers),
    ("packing", length_batches),
]

#: Stages hash and score outside what SQL can express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder; what only
    earlier stages needed is deleted on the way."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = shared_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
