"""Mixing sources to target weights, where sources may share documents.

Documents are aggregated by the set of sources they are in. A min-cost flow routes
the words of each set to the quotas of its sources; a further copy of a set's
words costs more than the one before, so nothing is repeated while unused words
can serve. Then documents are drawn by a seed until each set has given its share.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import SPACE, Shared, components, looked_up
from tomewright.llm.prefix import positions


class Network:
    """A flow network with whole capacities; arcs are stored with their reverse."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.left: list[int] = []

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.arcs[x].append(len(self.head))
            self.head.append(y)
            self.left.append(c)
        return len(self.head) - 2

    def _levels(self, source: int, sink: int) -> list[int]:
        level, queue = [-1] * len(self.arcs), deque([source])
        level[source] = 0
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.left[e] and level[self.head[e]] < 0:
                    level[self.head[e]] = level[a] + 1
                    queue.append(self.head[e])
        return level if level[sink] >= 0 else []

    def augment(self, source: int, sink: int) -> None:
        """Send what can be sent, along shortest paths in blocks."""
        while level := self._levels(source, sink):
            turn, path, at = [0] * len(self.arcs), [], source
            while True:
                if at == sink:
                    least = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= least
                        self.left[e ^ 1] += least
                    path, at = [], source
                    continue
                while turn[at] < len(self.arcs[at]):
                    e = self.arcs[at][turn[at]]
                    if self.left[e] and level[self.head[e]] == level[at] + 1:
                        break
                    turn[at] += 1
                else:
                    if not path:
                        break
                    at = self.head[path.pop() ^ 1]
                    turn[at] += 1
                    continue
                path.append(e)
                at = self.head[e]


def cheapest_flow(words: list[int], members: list[list[int]], quotas: list[int], copies: int) -> dict[tuple[int, int], int]:
    """Words that set p gives source s, by (p, s): as many as quotas and ``copies`` of
    every set allow, at least cost, where the k-th copy of a set costs k.

    All cost lies on the arcs of copies, and a path leaves the start once; so
    shortest paths use the lowest copy that has words left, and it is enough to
    open the copies one by one and augment to the full in between.
    """
    n, m = len(words), len(quotas)
    net = Network(n + m + 2)
    start, end = n + m, n + m + 1
    arcs = {(p, s): net.arc(p, n + s, copies * words[p]) for p in range(n) for s in members[p]}
    for s, q in enumerate(quotas):
        net.arc(n + s, end, q)
    for _ in range(copies):
        for p, w in enumerate(words):
            net.arc(start, p, w)
        net.augment(start, end)
    return {k: net.left[e ^ 1] for k, e in arcs.items()}


def water_level(sources: DataFrame, percent: int, all_words: int, copies: int) -> DataFrame:
    """``sources(number, source_size, weight)`` with target: ``percent`` of all words
    shared by weight, none over ``copies`` times its own size, the excess shared
    anew until none is above. A round aggregates the sources to one row."""
    cap = F.col("source_size") * copies
    big = lambda c: c.cast("decimal(38,0)")
    full = F.lit(False)
    while True:
        r = sources.agg(F.sum(F.when(full, cap).otherwise(0)).alias("c"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w"), F.count_if(full).alias("n")).first()
        above, below = percent * all_words - 100 * (r.c or 0), 100 * (r.w or 0)
        if not below:
            return sources.withColumn("target", cap.cast("double"))
        reaches = big(F.col("weight")) * F.lit(above).cast("decimal(38,0)") >= big(cap) * F.lit(below).cast("decimal(38,0)")
        if sources.where(full | reaches).count() == r.n:
            share = F.col("weight") * F.lit(float(above)) / F.lit(float(below))
            return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(share))
        full = full | reaches


def _flow(copies: int):
    def run(sets: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sets, sources = sets.sort_values("pattern"), sources.sort_values("number")
        at = {x: i for i, x in enumerate(sources["number"])}
        members = [[at[x] for x in sorted(m)] for m in sets["members"]]
        flow = cheapest_flow([int(x) for x in sets["words"]], members, [int(x) for x in sources["quota"]], copies)
        names, numbers = list(sets["pattern"]), list(sources["number"])
        return pd.DataFrame([(names[p], numbers[s], f) for (p, s), f in flow.items()], columns=["pattern", "number", "flow"])

    return run


def _numbered(sources: DataFrame, weights: list[int], shared: Shared) -> DataFrame:
    """Sources by code point, null last, with a number and a weight in turn."""
    ordered = sources.withColumns({"last": F.col("source").isNull().cast("int"), "one": F.lit(1).cast("long")})
    placed = positions(ordered, ["last", "source"], "one", shared)
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("row_before", F.lit(len(weights))) + 1).cast("int"))
    return shared.keep(placed.select("source", "source_size", F.col("row_before").alias("number"), turn.cast("long").alias("weight")))


def _routed(patterns: DataFrame, targets: DataFrame, copies: int, shared: Shared) -> DataFrame:
    """(pattern, number, flow). Sets and sources that are linked by overlaps form a
    component, whose network is solved in one task: its size is that of the
    distinct sets of sources there, not of their documents."""
    links = patterns.where(F.size("members") > 1).select(F.explode("members").alias("u"), F.array_min("members").alias("v")).where("u <> v")
    if links.isEmpty():
        homes = targets.select("number", F.col("number").alias("home"))
    else:
        joined = components(links, shared).select(F.col("node").alias("number"), F.col("component").alias("home"))
        homes = targets.select("number").join(joined, "number", "left").select("number", F.coalesce("home", "number").alias("home"))
    quotas = targets.join(homes, "number").select("home", "number", F.floor(F.col("target") + 0.5).alias("quota"))
    sets = patterns.withColumn("number", F.array_min("members")).join(homes, "number").select(F.col("home").alias("at"), "pattern", "members", "words")
    return sets.groupBy("at").cogroup(quotas.groupBy("home")).applyInPandas(_flow(copies), "pattern string, number long, flow long")


def _drawn(sized: DataFrame, plan: DataFrame, rows: int, shared: Shared) -> DataFrame:
    """``sized`` with taken. Of each pattern all documents are taken ``whole`` times,
    and once more those that stand first in the order of the seed, until they give
    ``rest`` words: the last of them gives its first words only. A pattern of any
    size is spread over the ranges of one global order."""
    placed = shared.keep(positions(sized, ["pattern", "turn", "doc_id", "size"], "size", shared))
    begins = placed.groupBy("pattern").agg(F.min("sum_before").alias("begin"))
    out = looked_up(placed, "pattern", shared.keep(plan.join(begins, "pattern")), rows)
    more = F.greatest(F.least(F.col("rest") - (F.col("sum_before") - F.col("begin")), F.col("size")), F.lit(0))
    return out.withColumn("taken", F.col("size") * F.col("whole") + more)


def mix_sources(
    docs: DataFrame, sources: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, copies: int = 2, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, size, pattern, shares, taken) for every row of ``docs``.

    ``sources`` is the column of a document's source, or of an array of them; a
    null is a source of its own, an empty array counts as null. Sources in the
    order of code points, null last, get ``weights`` in turn and share
    ``percent`` of all words; targets stop at ``copies`` times the source's
    words. ``size`` is the text's words (a null text: 0), ``pattern`` the set of
    sources as JSON, ``shares`` one (source, source_size, target, flow) for each
    of them, flow being what the pattern gives the source in all, and ``taken``
    the words that the mix takes of the row, at most ``copies`` times its size. Of
    each pattern one document at most is taken in part, so that its sources get
    their targets to the word, whatever the length of documents.

    The draw goes by SHA-256 of seed and id; rows of one id follow by size, and
    equal rows count each for itself. So reruns agree, whatever the partitions.
    An empty table gives no rows. A text is split within its row, then only
    numbers and source names go on. Other columns are not read.
    """
    shared = Shared(docs.sparkSession)
    given = F.col("source") if sources is None else sources
    kind = docs.select(given.alias("s")).schema["s"].dataType.typeName()
    if kind != "array":
        given = F.array(given.cast("string"))
    given = F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(F.array(F.lit(None).cast("string"))).cast("array<string>")
    doc_id = F.col(f"`{id_col}`").cast("long")
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SPACE), "")).cast("long")
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    sized = docs.select(doc_id.alias("doc_id"), words.alias("size"), F.array_sort(F.array_distinct(given)).alias("sources"), F.substring(turn, 1, 16).alias("turn"))
    sized = shared.keep(sized.select("doc_id", "size", "turn", F.to_json("sources").alias("pattern")))
    sets = shared.keep(sized.groupBy("pattern").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    total = sets.agg(F.sum("words").alias("w"), F.sum("n").alias("n")).first()
    all_words, rows = total.w or 0, total.n or 0
    named = sets.select("pattern", "words", F.explode(F.from_json("pattern", "array<string>")).alias("source"))
    sizes = named.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = shared.keep(water_level(_numbered(sizes, list(weights), shared), percent, all_words, copies))
    named = named.join(targets.select("source", "number"), named["source"].eqNullSafe(targets["source"])).select("pattern", "words", "number")
    patterns = shared.keep(named.groupBy("pattern").agg(F.first("words").alias("words"), F.array_sort(F.collect_list("number")).alias("members")))
    flows = shared.keep(_routed(patterns, targets, copies, shared))
    share = F.struct("source", "source_size", "target", "flow")
    given = flows.join(targets, "number").groupBy("pattern").agg(F.sum("flow").alias("give"), F.array_sort(F.collect_list(F.struct("number", share.alias("share")))).alias("by"))
    whole = F.when(F.col("words") > 0, F.floor(F.col("give") / F.col("words"))).otherwise(0)
    plan = patterns.join(given, "pattern").withColumn("whole", whole.cast("long"))
    plan = plan.select("pattern", "whole", (F.col("give") - F.col("whole") * F.col("words")).alias("rest"), F.col("by.share").alias("shares"))
    return _drawn(sized, plan, rows, shared).select("doc_id", "size", "pattern", "shares", "taken")
