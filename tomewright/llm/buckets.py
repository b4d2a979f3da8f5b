"""Length buckets of least padding, and batches under a token budget."""

from __future__ import annotations

from array import array
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import Shared
from tomewright.llm.prefix import positions


def best_bounds(keys: list[int], counts: list[int], tokens: list[int], n_buckets: int) -> list[int]:
    """Upper bounds of at most ``n_buckets`` buckets that minimise padding, exactly.

    Dynamic programming over the sorted histogram: the best cost of the first j
    lengths in k buckets is the least over i < j of the best of the first i in
    k - 1 plus the padding of lengths i+1..j to the j-th, key_j * (c_j - c_i) -
    (s_j - s_i). For one k each i is a line in key_j of slope -c_i; slopes fall
    with i and keys rise with j, so a lower envelope that is read from its front
    gives all j in linear time. Whole numbers throughout.
    """
    if not keys:
        return []
    n, c, s = len(keys), [0, *accumulate(counts)], [0, *accumulate(tokens)]
    best = [0, *(key * c[j] - s[j] for j, key in enumerate(keys, 1))]  # one bucket
    best_of, came = [best[n]], [array("q", bytes(8 * (n + 1)))]
    for _ in range(1, min(n_buckets, n)):
        new, src, front = [0] * (n + 1), array("q", bytes(8 * (n + 1))), 0
        lines: list[tuple[int, int, int]] = []  # slope, height, i
        for j, key in enumerate(keys, 1):
            slope, height = -c[j - 1], best[j - 1] + s[j - 1]
            # the last line goes where the new one passes below the one before it no later
            while len(lines) - front > 1:
                (m0, h0, _), (m1, h1, _) = lines[-2:]
                if (height - h0) * (m0 - m1) > (h1 - h0) * (m0 - slope):
                    break
                lines.pop()
            lines.append((slope, height, j - 1))
            while front + 1 < len(lines) and lines[front + 1][0] * key + lines[front + 1][1] <= lines[front][0] * key + lines[front][1]:
                front += 1
            m, h, src[j] = lines[front]
            new[j] = m * key + h + key * c[j] - s[j]
        best = new
        came.append(src)
        best_of.append(best[n])
    k = best_of.index(min(best_of))
    bounds, j = [], n
    while j > 0:
        bounds.append(keys[j - 1])
        j, k = came[k][j], max(k - 1, 0)
    return bounds[::-1]


def batches(
    docs: DataFrame, n_buckets: int = 16, budget: int = 32_768, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None
) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_tokens, batch, slot, padding), a row for
    each of ``docs``.

    ``length`` defaults to the words of the text (none for null). Buckets are the
    optimal ones for the global histogram; inside a bucket, in the order of ids,
    documents fill batches of at most ``budget`` padded tokens, one at least.
    ``batch`` counts from 0 in its bucket, ``slot`` in its batch. Only id and
    length are shuffled, null ids first; equal rows fill places of their own, and a
    document longer than ``budget`` is a batch by itself. The histogram has a
    row for each length there is. It comes to the driver, which is safe at any
    size: m different lengths need m * (m - 1) / 2 words, so texts of w words in
    all have at most sqrt(2 * w) + 1 lengths.
    """
    spark = docs.sparkSession
    if length is None:
        length = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    shared = Shared(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), length.cast("long").alias("n_tokens"))
    rows = shared.keep(rows)
    hist = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").collect()
    bounds = best_bounds([r.n_tokens for r in hist], [r.n for r in hist], [r.n_tokens * r.n for r in hist], n_buckets)
    bucket, upper = F.lit(len(bounds) - 1), F.lit(bounds[-1] if bounds else 0)
    for i, b in reversed(list(enumerate(bounds[:-1]))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
        upper = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(upper)
    dealt = rows.select("doc_id", "n_tokens", bucket.cast("int").alias("bucket"), upper.cast("long").alias("bucket_tokens"), F.lit(1).cast("long").alias("one"))
    at = positions(dealt, ["bucket", "doc_id", "n_tokens"], "one", shared)
    first = at.groupBy("bucket").agg(F.min("row_before").alias("first_row"))  # a row for each bucket
    place = F.col("row_before") - F.col("first_row")
    room = F.greatest(F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))), F.lit(1)).cast("long")
    return at.join(F.broadcast(first), "bucket").select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(place / room).cast("long").alias("batch"), (place % room).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
