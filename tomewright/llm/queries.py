"""The registered query of each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.audit import audit_filters
from tomewright.llm.bpe import encode_decode
from tomewright.llm.buckets import batches
from tomewright.llm.common import table
from tomewright.llm.importance import importance
from tomewright.llm.jaccard import jaccard_groups
from tomewright.llm.licenses import scan_licenses
from tomewright.llm.mixing import mix_sources
from tomewright.llm.packing import pack_tokens
from tomewright.llm.pii import scan_pii
from tomewright.llm.quality import quality
from tomewright.llm.repeats import remove_repeats
from tomewright.llm.shard import shard_by_bytes
from tomewright.llm.vectors import near_vectors

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches(table(spark, sf_dir, "documents"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_pii(table(spark, sf_dir, "documents")).drop("pieces")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, keep_ids=False)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), grams=1, buckets=10_000, percent=10, min_words=20, seed=2024)
    return out.drop("n_words")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), percent=150, copies=2)
    share = F.col("shares")[0]
    return out.select("doc_id", "size", share["source_size"].alias("source_size"), share["target"].alias("target"), "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    listed = (
        op1_suffix_dedup, op2_token_output, op3_packing, op4_vectors, op5_jaccard, op6_pii, op7_quality, op8_sharding, op9_license_scan, op10_bpe,
        op11_importance, op12_filter_audit, op13_mixing,
    )
    return {f.__name__: f for f in listed} | {"pipeline": pipeline}
