"""Importance resampling towards a target text, over hashed n-grams.

The features of a text are its runs of 1 to n words, joined by one space; the
bucket of a feature is the CRC-32 of its bytes modulo the number of buckets. The
CRC of each word is computed once. That of a longer run follows from those of its
parts: appending k bytes multiplies the CRC before them by a matrix over GF(2)
that depends on k alone, so no run is ever written out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tomewright.llm.common import Shared, id_and_text
from tomewright.llm.prefix import positions
from tomewright.llm.rolling import byte_chunks

#: The polynomial of CRC-32, lowest power first.
POLYNOMIAL = 0xEDB88320
#: Bytes of words (digits, small letters, all beyond ASCII) after lower-casing A-Z.
WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Words longer than this are hashed one by one.
TOGETHER = 64


def _byte_steps() -> np.ndarray:
    """What a register's lowest byte adds to it when a byte is shifted out."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


STEPS = _byte_steps()


def _as_tables(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), by its columns, as 4 tables of 256 sums."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        has = (np.arange(256) >> (bit % 8)) & 1 == 1
        out[bit // 8, has] ^= columns[bit]
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0, x & 255] ^ tables[1, (x >> 8) & 255] ^ tables[2, (x >> 16) & 255] ^ tables[3, x >> 24]


def _shifts() -> list[np.ndarray]:
    """The matrices of 1, 2, 4, ... 2**31 zero bytes, each the square of the last."""
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_as_tables(STEPS[units & 255] ^ (units >> 8))]
    while len(out) < 32:
        out.append(_as_tables(_times(out[-1], _times(out[-1], units))))
    return out


SHIFTS = _shifts()


def followed(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many further zero bytes as ``lengths`` says: what it
    contributes to the CRC of a longer string."""
    out = crc.astype(np.uint32)
    for bit in range(int(lengths.max(initial=0)).bit_length()):
        there = (lengths >> bit) & 1 == 1
        out[there] = _times(SHIFTS[bit], out[there])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word of the texts data[offsets[i]:offsets[i + 1]]."""
    inside = np.concatenate([[False], WORD[data], [False]])
    cut = np.zeros(len(data) + 1, bool)  # a text begins or ends here
    cut[offsets] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each data[start:end], byte by byte over all words at once."""
    n = end - start
    order = np.argsort(-n, kind="stable")
    begun, left = start[order], n[order]
    long = int(np.searchsorted(-left, -TOGETHER, "left"))
    register = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for j in range(int(left[long]) if long < len(n) else 0):
        to = int(np.searchsorted(-left, -j, "left"))  # those with more than j bytes
        r = register[long:to]
        register[long:to] = STEPS[(r ^ data[begun[long:to] + j]) & 255] ^ (r >> 8)
    out = np.empty(len(n), np.uint32)
    out[order] = ~register
    for i in order[:long]:
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def gram_crcs(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For k = 1 to ``most``: (text, CRC-32) of each run of k words within one text."""
    start, end, text = words_of(data, offsets)
    crc, n = word_crcs(data, start, end), end - start
    run = crc
    yield text, run
    if most > 1:
        space = np.full(len(n), zlib.crc32(b" "), np.uint32)
        spaced = followed(space, n) ^ crc
    for k in range(2, most + 1):
        last = len(n) - k + 1
        if last <= 0:
            return
        run = followed(run[:last], n[k - 1 :] + 1) ^ spaced[k - 1 :]
        whole = text[:last] == text[k - 1 :]
        yield text[:last][whole], run[whole]


def _counted(grams: int, buckets: int):
    """(bucket, n) of the features of a partition's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, data, offsets in byte_chunks(b.column(0)):
                for _, crc in gram_crcs(LOWER[data], offsets, grams):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, grams: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the column ``text``. A task sends a row for
    each bucket at most, and the driver gets ``buckets`` numbers."""
    rows = texts.select("text").mapInArrow(_counted(grams, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to its share
    in the raw texts, both with one more of each bucket, rounded down."""
    s, t, n = raw.astype(np.float64), target.astype(np.float64), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def _weighed(gains: np.ndarray, grams: int):
    """The columns of each batch but the text, then n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for i, data, offsets in byte_chunks(b.column(0)):
                n = len(offsets) - 1
                total, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k, (text, crc) in enumerate(gram_crcs(LOWER[data], offsets, grams)):
                    count = np.bincount(text, minlength=n)
                    sums = np.concatenate([[0], np.cumsum(gains[crc % np.uint32(len(gains))])])
                    ends = np.cumsum(count)
                    total += sums[ends] - sums[ends - count]
                    found += count
                    if not k:
                        out[0, i : i + n] = count
                out[1, i : i + n], out[2, i : i + n] = found, total // np.maximum(found, 1)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, out)], names=[*b.schema.names[1:], "n_words", "n_features", "weight"])

    return run


def _noise(seed: int) -> Column:
    """Thousandths of a Gumbel variate that the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _ranked(scored: DataFrame, percent: int, min_words: int, shared: Shared) -> DataFrame:
    """``scored`` with rank, null for what is not drawn: one range shuffle of
    a few numbers a row."""
    scored = shared.keep(scored)
    fit = scored.where(F.col("n_words") >= min_words).withColumn("down", -F.col("score"))
    placed = positions(fit, ["down", "doc_id", "n_features"], "n_words", shared)
    drawn = F.col("row_before") < F.floor(F.lit(percent) * F.col("rows_all") / 100)
    fit = placed.withColumn("rank", F.when(drawn, F.col("row_before") + 1)).select(*scored.columns, "rank")
    return fit.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def _gains(docs: DataFrame, target: DataFrame, grams: int, buckets: int) -> np.ndarray:
    target = target.select(F.col("text").cast("string").alias("text"))
    return bucket_gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))


def importance(
    docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``.

    ``weight`` is the mean gain of a text's features, rounded down; a text without
    words has none and weighs 0. ``score`` adds Gumbel noise, so that the
    floor(percent * N / 100) highest scores among the N texts of ``min_words`` or
    more are a draw without replacement in proportion to exp(weight / 1000).
    Ties go to the smaller id, a null id before all (its noise is that of an
    empty id), then to fewer features; equal rows get ranks next to each other.

    Null texts are empty. Texts of any length count whole: a task holds some 40
    bytes for each byte of the text at hand, and texts of more than a megabyte
    go one by one. Empty tables give no rows; an empty target weighs all texts by
    how rare they are. Other columns are not read. Two passes read the texts;
    ``buckets`` numbers go through the driver, and (id, score) are shuffled once.
    """
    texts = id_and_text(docs, id_col, text_col)
    gains = _gains(texts, target, grams, buckets)
    weighed = texts.select("text", "doc_id").mapInArrow(_weighed(gains, grams), "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + _noise(seed))
    return _ranked(scored, percent, min_words, Shared(docs.sparkSession))


def resampled(
    docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The drawn rows of ``docs`` themselves, all columns as they are.

    No join by id: the last drawn (score, id, features) is found first, and every
    row that does not come after it stays. So ids may repeat or be null; rows that
    equal the last one in all three stay with it.
    """
    texts = id_and_text(docs, id_col, text_col)
    gains, shared = _gains(texts, target, grams, buckets), Shared(docs.sparkSession)
    schema = "doc_id long, n_words long, n_features long, weight long"
    scored = texts.select("text", "doc_id").mapInArrow(_weighed(gains, grams), schema).withColumn("score", F.col("weight") + _noise(seed))
    ranked = _ranked(scored, percent, min_words, shared)
    last = ranked.where(F.col("rank").isNotNull()).agg(F.max_by(F.struct("score", "doc_id", "n_features"), "rank")).first()[0]
    if last is None:
        return docs.limit(0)
    row = F.struct("*").alias("row")
    whole = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), row)
    numbers = [StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]
    again = whole.mapInArrow(_weighed(gains, grams), StructType([*whole.schema.fields[1:], *numbers]))
    again = again.withColumn("score", F.col("weight") + _noise(seed))
    here = [-F.col("score"), F.col("doc_id").isNotNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("n_features")]
    there = [-last.score, int(last.doc_id is not None), last.doc_id or 0, last.n_features]
    after, same = F.lit(False), F.lit(True)
    for a, b in zip(here, there, strict=True):
        after, same = after | (same & (a > b)), same & (a == b)
    return again.where((F.col("n_words") >= min_words) & ~after).select("row.*")
