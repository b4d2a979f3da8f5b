"""How filters interact: what each removes in every order, from subset survivors.

Rows are counted once by part and failures. A CUBE over these counts gives, for
every subset of the filters, how many rows pass all of it; every figure of every
order is a difference of two such numbers, so no order is ever run over the rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.common import SPACE, Shared, looked_up

#: What is summed besides rows.
SUMS = ("n", "good", "toxic")


def text_failures(text: Column) -> dict[str, Column]:
    """The failures that a text shows by itself; ``text`` is not null."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": F.size(F.array_distinct(words)) * 100 < n * 65,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def repeats_earlier(facts: DataFrame, rows: int) -> DataFrame:
    """``facts(doc_id, key, ..)`` with E: whether a smaller id has the same key.

    Only keys of more than one row are looked up; rows of a key are aggregated
    before the shuffle, and frequent keys are not gathered.
    """
    some = facts.where(F.col("doc_id").isNotNull())
    first = some.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return looked_up(facts, "key", first, rows).withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")


def subset_survivors(flags: DataFrame, filters: str) -> DataFrame:
    """(part, subset, n, good, toxic) for every part and subset of ``filters``, given
    as a number whose bit i stands for filter i: what fails none of the subset.

    ``flags`` has a Boolean column for each filter, ``part`` and the counts of
    SUMS. Zeros are included. The CUBE runs over at most 2**k rows a part.
    """
    k = len(filters)
    cells = flags.groupBy("part", *filters).agg(*[F.sum(c).alias(c) for c in SUMS])
    # grouping_id: the part is the highest bit, then the filters; set where a column is summed over
    cube = cells.cube("part", *filters).agg(*[F.sum(c).alias(c) for c in SUMS], F.grouping_id().alias("g"))
    passed = F.lit(True)
    for f in filters:
        passed = passed & ~F.coalesce(F.col(f), F.lit(False))
    subset = sum((F.when(F.col("g").bitwiseAND(1 << (k - 1 - i)) == 0, 1 << i).otherwise(0) for i in range(k)), F.lit(0))
    found = cube.where((F.col("g") < 1 << k) & passed).select("part", subset.alias("subset"), *SUMS)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS])


def interactions(survivors: DataFrame, filters: str, shared: Shared) -> DataFrame:
    """All orders of ``filters``, step by step, from ``survivors``, which is kept.

    Each step joins the survivors of the filters before it with those after it.
    The tables of steps have k * k! and 4 * k rows, k being the number of filters
    (600 and 20 for five), and are broadcast.
    """
    spark, k = survivors.sparkSession, len(filters)
    full, bit = (1 << k) - 1, {f: 1 << i for i, f in enumerate(filters)}
    steps = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            steps.append(("".join(order), i + 1, f, before, before | bit[f]))
            before |= bit[f]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int, after int"))
    alone = [(f, m, a, b) for f in filters for m, a, b in ((0, 1, 0), (bit[f], -1, 0), (full & ~bit[f], 0, 1), (full, 0, -1))]
    alone = F.broadcast(spark.createDataFrame(alone, "filter string, subset int, failing int, only int"))
    survivors = shared.keep(survivors)
    fails = survivors.join(alone, "subset").groupBy("part", "filter")
    fails = fails.agg(F.sum(F.col("n") * F.col("failing")).alias("failing"), F.sum(F.col("n") * F.col("only")).alias("unique_fails"))
    was = survivors.join(steps, survivors.subset == steps.before).drop("subset", "before")
    now = survivors.select("part", F.col("subset").alias("after"), *[F.col(c).alias(f"{c}_kept") for c in SUMS])
    lost = {"removed": "n", "good_lost": "good", "toxic_lost": "toxic"}
    pairs = was.join(now, ["part", "after"]).withColumns({a: F.col(c) - F.col(f"{c}_kept") for a, c in lost.items()})
    out = pairs.join(fails, ["part", "filter"]).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    return out.select(
        "part", "filter_order", "step", F.col("n_kept").alias("kept"), "removed", (F.col("failing") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def failing_rows(docs: DataFrame, labels: DataFrame, shared: Shared, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, A, B, C, D, E, n, good, toxic): a row of ``docs`` each, with its failures.

    A: under 50 words. B: distinct words under 65 % of them. C: over 5 % of the
    characters are A-Z. D: a character of ``#$%&*|``. E: a smaller id has the same
    text (told by SHA-256), in any part. A document is good or toxic if any row
    of ``labels`` with its id says so. A row with a null id fails no E, makes no
    other fail it, and has no labels; rows of one id don't fail each other.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    facts = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("key"),
        *[c.alias(f) for f, c in text_failures(text).items()],
    )
    facts = shared.keep(facts)
    rows = facts.count()
    facts = shared.keep(repeats_earlier(facts, rows).drop("key"))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = looked_up(facts, "doc_id", said, rows)
    count = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c)
    return known.select("part", *"ABCDE", F.lit(1).cast("long").alias("n"), count("good"), count("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, each of the 120 orders of the filters A to E and step.

    Per part (a null one is ''): ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing its filter but removed earlier), ``unique_fails``
    (failing no other filter), ``good_lost`` and ``toxic_lost`` of the removed, and
    ``shapley``: what its filter removes, summed over all orders.

    A null text is empty: it fails A alone, and E where a smaller id has none
    either. Very long texts are split into words within their row; repeated rows
    count as often as they stand; an empty table gives no rows; other columns
    are not read. Texts are read once, and of each row some 60 bytes go on.
    """
    shared = Shared(docs.sparkSession)
    flags = failing_rows(docs, labels, shared, id_col, text_col, part_col)
    return interactions(subset_survivors(flags, "ABCDE"), "ABCDE", shared)
