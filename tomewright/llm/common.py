"""What the operators of this subpackage share: inputs, shared tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.shared import looked_up, partitions, shared_folder

__all__ = ["SPACE", "Shared", "components", "delete", "id_and_text", "looked_up", "may_be_in", "partitions", "shared_folder", "table", "text_key"]

#: White space that ends a word: space and the controls from tab to return.
SPACE = r"[\x20\x09-\x0D]+"

#: Words of 64 bits of the filter that spares most rows a shuffle.
FILTER = 1 << 17

#: Nodes that a partition holds at once while contracting edges.
CONTRACT = 1_000_000
#: Edges of one node that go to one task; of more, each part goes to another.
HUB = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where it is set, the shuffle files of a write go when the write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Shared:
    """The intermediate tables of one call of an operator, in the shared folder;
    they cut lineage for good.

    ``keep(df)`` writes and rereads; what the write shuffled is let go. ``drop(df)``
    deletes a table that no later step reads, ``only(df, ..)`` all but those that
    the result still reads, so that the disk holds only what is needed. Each
    object deletes its own tables and no others.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path, was = shared_folder(self.spark), self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if was is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                delete(self.spark, path)

    def only(self, *frames: DataFrame) -> None:
        kept = {id(df) for df in frames}
        self.drop(*[df for _, df in list(self.paths.values()) if id(df) not in kept])


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, under fixed names, so that no extra
    column of the input can clash with a name used inside."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def text_key(doc_id: str | Column, text_hash: str | Column) -> Column:
    """What names a row by its id, null or not, and its text."""
    return F.xxhash64(doc_id, text_hash)


def may_be_in(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` in two parts: rows whose ``key`` may be among ``wanted``'s, and rows
    whose key surely is not, so that only the first need a shuffle to be joined.
    It goes by a bit for each of 64 * FILTER residues of the key: a table of
    FILTER rows at most is broadcast, whatever the size of ``wanted``; where that
    is very large the first part is nearly all of ``df``."""
    word = lambda k: F.pmod(F.shiftrightunsigned(k, 6), F.lit(FILTER))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(k, F.lit(64)).cast("int"))
    at, held = (f"_{uuid.uuid4().hex}" for _ in range(2))
    words = wanted.groupBy(word(wanted_key).alias(at)).agg(F.bit_or(bit(wanted_key)).alias(held))
    both = df.join(F.broadcast(words), word(key) == words[at], "left")
    there = (F.coalesce(F.col(held), F.lit(0)).bitwiseAND(bit(key))) != 0
    return tuple(both.where(x).drop(at, held) for x in (there, ~there))


def _contracted(most: int):
    """For each node of the edges of one partition the smallest node it reaches
    over them. At ``most`` nodes what is there goes out, so memory is bounded;
    what was connected stays so, but may be in several stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            ends = [(x, root(x)) for x in list(parent)]
            u, v = ([e[k] for e in ends if e[0] != e[1]] for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a, c = root(u), root(v)
                if a != c:
                    parent[max(a, c)] = min(a, c)
            if len(parent) >= most:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return run


def _with_least(edges: DataFrame, key: str, most: int) -> DataFrame:
    """``edges(u, v)``, u > v, with m: the smallest node next to the end ``key``, or
    that end itself. Minima are aggregated before the shuffle; those of ends with
    over ``most`` edges, which are few, are broadcast, so no task gets a hub."""
    least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    hubs = edges.groupBy(F.col(key).alias("node")).count().where(F.col("count") > most).select("node")
    hubs = F.broadcast(hubs.join(least, "node", "left").select(F.col("node").alias(key), F.coalesce("m", "node").alias("m")))
    least = least.withColumnRenamed("node", key)
    rest = edges.join(hubs.select(key), key, "left_anti").join(least, key, "left")
    return edges.join(hubs, key).unionByName(rest).select("u", "v", F.coalesce("m", key).alias("m"))


def _starred(edges: DataFrame, shared: Shared, most: int) -> DataFrame:
    """One large-star and one small-star step: every edge goes to the smallest
    node next to its smaller end, then to that next to its larger end. There are
    never more distinct edges, and nothing must fit one partition."""
    edges = shared.keep(edges.distinct())
    large = shared.keep(_with_least(edges, "v", most).select("u", F.col("m").alias("v")).distinct())
    both = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    small = shared.keep(_with_least(large, "u", most).select(both.alias("e")).select("e.*").where("u <> v").distinct())
    shared.drop(edges, large)
    return small


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Count of edges, and whether each node has one root that is itself no child."""
    end = lambda node, root: F.struct(F.col(node).alias("node"), root.alias("root"))
    ends = edges.select(F.explode(F.array(end("u", F.col("v")), end("v", F.col("v")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"))
    n, split = nodes.agg(F.sum("n"), F.count_if(F.col("lo") < F.col("hi"))).first()
    return (n or 0) // 2, not split


def _sent(edges: DataFrame, n: int) -> DataFrame:
    """Each edge to the partitions of both its ends. Those of a hub are spread:
    each of its parts gives a star of its own, and these meet in the next round.
    At most some thousands of nodes have that many of the ``n`` edges."""
    most = max(HUB, n // 1000)
    ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("key"))
    hubs = ends.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hubs = hubs.select("key", F.ceil(F.col("n") / most).alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("u", "v"), "parts"), F.lit(0))
    return ends.join(F.broadcast(hubs), "key", "left").withColumn("part", part).repartition("key", "part").select("u", "v")


def components(edges: DataFrame, shared: Shared, max_rounds: int = 80) -> DataFrame:
    """(node, component): for each node of ``edges(u, v)`` the smallest node that
    it reaches. In each round every edge goes to the partitions of both its ends,
    which replace what they hold by stars around the smallest nodes; so a node
    meets the neighbours of its neighbours, and paths shrink by half. A round is
    one shuffle of the edges, written to the shared folder. Where there may be more nodes than
    a partition holds, rounds of large-star and small-star take over, which are
    exact at any size. It ends when every node has one root and no root a root of
    its own, which is checked in each round.
    """
    most = CONTRACT
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = shared.keep(now)
    kept, starring, n = [now], False, now.count()
    for k in range(max_rounds):
        if starring:
            new = _starred(now, shared, most)
        else:
            new = shared.keep(_sent(now, n).mapInArrow(_contracted(most), "u long, v long"))
        shared.drop(*kept)
        now, kept = new, [new]
        n, settled = _state(now)
        if settled:
            break
        # n edges have at most 2 * n nodes; the rounds that contract need few rounds where all fits
        starring = starring or 2 * n >= most or k >= 20
    else:
        raise RuntimeError("components did not settle")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component"))))
    out = shared.keep(now.select(ends.alias("e")).select("e.*").distinct())
    shared.drop(now)
    return out
