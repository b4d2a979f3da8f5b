"""Quality rules and hashed n-gram likelihood ratios, in DataFrame functions only.

Trusted text (labelled good and not toxic) gives one multinomial over hashed
one- and two-word grams, the whole corpus another. A document's score is the
mean over its grams of the difference of log probabilities. All scores are sums
of whole ten-thousandths, so no order of addition changes a verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import SPACE, Shared, id_and_text

#: Scores are whole numbers of 1/SCALE nats.
SCALE = 10_000
WINDOW = 8


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hashed_words(text: Column) -> tuple[Column, Column]:
    words = F.array_remove(F.split(text, SPACE), "")
    return words, F.transform(words, lambda w: F.xxhash64(w))


def grams(hashes: Column, n_buckets: int) -> Column:
    """Buckets of all words and all neighbouring pairs of words."""
    low = F.lit(n_buckets)
    one = F.transform(hashes, lambda h: F.pmod(h, low))
    pair = F.zip_with(
        F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 1, F.lit(0))),
        F.slice(hashes, 2, F.greatest(F.size(hashes) - 1, F.lit(0))),
        lambda a, b: F.pmod(F.shiftright(a, 1).bitwiseXOR(F.shiftright(b, 2)), low),
    )
    return F.concat(one, pair)


def covered_words(windows: Column) -> Column:
    """Words in windows whose hash stands at two places or more: sort (hash,
    place), keep places with an equal neighbour, add up what each one covers
    beyond the place before it."""

    def places(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | ((k > 0) & same(x, F.get(s, F.greatest(k - 1, F.lit(0))))))
        return F.array_sort(F.transform(twice, lambda x: x["at"]))

    by_hash = F.array_sort(F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        _bind(by_hash, places),
        start,
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )


def gram_ratios(texts: DataFrame, trusted_ids: DataFrame, n_buckets: int, smoothing: int = 1) -> DataFrame:
    """One row with ``ratios``: for each bucket the rounded log ratio.

    Raw counts are of every document; each task counts for itself first, so at
    most n_buckets rows leave a task. All ratios are 0 without trusted text.
    """
    marked = texts.join(F.broadcast(trusted_ids.withColumn("trusted", F.lit(1))), "doc_id", "left")
    _, hashes = hashed_words(F.col("text"))
    one = marked.select("trusted", hashes.alias("hashes"))
    each = one.select("trusted", F.explode(grams(F.col("hashes"), n_buckets)).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("good"))
    every = texts.sparkSession.range(n_buckets).join(counts, F.col("id") == F.col("bucket"), "left")
    rows = every.agg(
        F.sum(F.coalesce("raw", F.lit(0))).alias("all_raw"),
        F.sum(F.coalesce("good", F.lit(0))).alias("all_good"),
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")))).alias("each"),
    )
    share = lambda n, total: (n + F.lit(smoothing)) / (total + F.lit(smoothing * n_buckets))
    ratio = lambda x: F.round(F.lit(SCALE) * F.log(share(x["good"], F.col("all_good")) / share(x["raw"], F.col("all_raw")))).cast("long")
    return rows.select(F.when(F.col("all_good") > 0, F.transform("each", ratio)).otherwise(F.transform("each", lambda x: F.lit(0).cast("long"))).alias("ratios"))


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled ids, all labels good and none toxic; beyond
    that, those of smallest hash."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    good = rows.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0")
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id")


def quality(
    docs: DataFrame,
    labels: DataFrame,
    n_buckets: int = 32_768,
    most_trusted: int = 20_000,
    threshold: float = -0.25,
    min_words: int = 20,
    most_repeated: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
    whole_rows: bool = False,
) -> DataFrame:
    """A row for each of ``docs`` with the rule counts, score and verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), base_failed, kept (boolean), score (double, the mean log ratio; 0
    without words). ``kept`` is false if the base rules fail, else whether the
    score reaches ``threshold``. A null text has no words, so it fails. The
    trusted multinomial is fitted on at most ``most_trusted`` labelled documents,
    the raw one and all else on every document. Equal rows get equal results, and so
    do equal texts of different or null ids. A text of any length counts whole: its
    words and their hashes must fit a task. An empty table gives no rows.
    ``whole_rows`` adds the row of ``docs`` itself as the struct ``row``, so that
    a filter needs no join.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    shared = Shared(docs.sparkSession)
    trusted = shared.keep(trusted_ids(labels, most_trusted))
    ratios = gram_ratios(texts, trusted, n_buckets)

    text = F.col("text")
    words, hashes = hashed_words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    carried = ["row"] if whole_rows else []
    if whole_rows:
        texts = docs.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        )
    one = texts.select(
        *carried,
        "doc_id",
        hashes.alias("hashes"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    # size() beside the column keeps these steps apart: nothing below is evaluated twice
    n = F.size("hashes")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("hashes"), i, F.lit(WINDOW)))))
    two = one.withColumn("windows", F.coalesce(windows, F.array().cast("array<bigint>")))
    # n_buckets whole numbers, as a constant of the plan
    table = F.split(F.lit(",".join(map(str, ratios.first().ratios))), ",").cast("array<bigint>")
    total = F.aggregate(grams(F.col("hashes"), n_buckets), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b.cast("int")))
    repeated = F.when(F.size("windows") > F.size(F.array_distinct("windows")), covered_words(F.col("windows"))).otherwise(F.lit(0).cast("long"))
    out = two.select(
        *carried,
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        total.alias("total"),
        F.monotonically_increasing_id().alias("place"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    per_gram = F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words") - 1) / SCALE).otherwise(F.lit(0.0))
    # the row's place keeps a later filter on the verdict above these steps; pushed
    # below them it would evaluate whole arrays anew for each of their elements
    kept = ~failed & (F.col("score") >= threshold) & (F.col("place") >= 0)
    return out.withColumn("base_failed", failed).withColumn("score", per_gram).withColumn("kept", kept).drop("total", "place")
