"""Token ids in fixed-length rows, packed by best-fit decreasing."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tomewright.llm.bpe import read_ranks
from tomewright.llm.common import Shared, id_and_text, partitions


class Rooms:
    """Open rows by free capacity. A segment tree over capacities 0..most counts
    rows, so the tightest fit is found by one descent."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.tree[i] += n
            i >>= 1

    def put(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, row) of the least capacity that holds ``need``."""
        i = need + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up, until a right sibling has rows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of indices: longest first, each into the fullest row that holds it."""
    rooms, rows = Rooms(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            rows.append([i])
            rooms.put(size - lengths[i], len(rows) - 1)
        else:
            capacity, row = found
            rows[row].append(i)
            rooms.put(capacity - lengths[i], row)
    return rows


def pack_tokens(
    docs: DataFrame, vocabulary: str, pattern: str, row_tokens: int = 2048, window: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each packed row of ``row_tokens`` ids.

    pack_id (long, unique), n_used (int), doc_ids (array<long>) and parts
    (array<int>): which part of which document each segment is; cu_seqlens
    (array<int>): 0 and the end of each segment; positions (binary) and ids
    (binary): little-endian 16-bit integers (32-bit for vocabularies or rows
    beyond 65,536), padded with 0 after n_used. ``positions`` restarts at 0 with
    each segment. Documents longer than a row are split into parts 0, 1, ... in
    order, so joining the parts gives back all ids. Null and empty texts have no
    tokens and so stand in no row.

    Documents go by id, null first, and by text hash where an id repeats. All
    tokens before a document, divided by ``window``, give its window; each window
    is packed for itself, so a task holds one window and one document at most.
    Rows follow from the documents alone, not from how the input is split; equal
    rows are packed like others, a part for each. pack_id is the window's number
    and a count. Texts are shuffled once, by ranges, and encoded there; tokens
    once, by windows. An empty table gives no rows.
    """
    spark = docs.sparkSession
    shared, parts_n = Shared(spark), partitions(spark)
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    def kind(ranks: dict[bytes, int]) -> str:
        return "<u2" if max(ranks.values()) < 65_536 and row_tokens <= 65_536 else "<u4"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each text with tokens, and how many this range has before it."""
        ranks = read_ranks(sent.value)
        coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        width, part, total = kind(ranks), TaskContext.get().partitionId(), 0
        for b in batches:
            at, before, n, raw = [], [], [], []
            for i, x in enumerate(b.column(1)):
                ids = coder.encode_ordinary(x.as_py() or "")
                if ids:
                    at.append(i)
                    before.append(total)
                    n.append(len(ids))
                    raw.append(np.array(ids, width).tobytes())
                    total += len(ids)
            cols = [pa.array([part] * len(at), pa.int32()), b.column(0).take(pa.array(at, pa.int64())), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "doc_id", "before", "n", "tokens"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each window, from documents in the order of windows."""
        width = kind(read_ranks(sent.value))
        held: list[tuple[int | None, int, np.ndarray]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = best_fit([len(x[2]) for x in held], row_tokens)
            for k in range(0, len(rows), 500):
                cols: list[list] = [[] for _ in range(7)]
                for made, row in enumerate(rows[k : k + 500], (now << 32) + k):
                    parts = [held[i] for i in row]
                    ends = np.cumsum([0, *(len(x[2]) for x in parts)])
                    ids, at = np.zeros(row_tokens, width), np.zeros(row_tokens, width)
                    ids[: ends[-1]] = np.concatenate([x[2] for x in parts])
                    at[: ends[-1]] = np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
                    for col, v in zip(cols, (made, int(ends[-1]), [x[0] for x in parts], [x[1] for x in parts], ends.tolist(), at.tobytes(), ids.tobytes()), strict=True):
                        col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for place, doc, raw in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if place != now and held:
                    yield from flush()
                    held = []
                now = place
                ids = np.frombuffer(raw, width)
                held.extend((doc, part, ids[k : k + row_tokens]) for part, k in enumerate(range(0, len(ids), row_tokens)))
        if held:
            yield from flush()

    names = ["pack_id", "n_used", "doc_ids", "parts", "cu_seqlens", "positions", "ids"]
    schema = "pack_id long, n_used int, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, positions binary, ids binary"
    order = ["doc_id", "text_hash", "tie"]  # equal rows are spread over ranges too, as the last key is unique
    texts = id_and_text(docs, id_col, text_col).withColumns({"text_hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    dealt = texts.repartitionByRange(parts_n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    coded = shared.keep(dealt.mapInArrow(encoded, "part int, doc_id long, before long, n long, tokens binary"))
    ranges = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    start = coded.groupBy("part").agg(F.sum("n").alias("w")).select("part", F.coalesce(F.sum("w").over(ranges), F.lit(0)).alias("start"))
    placed = coded.join(F.broadcast(start), "part").withColumn("before", F.col("before") + F.col("start"))
    windows = placed.select(F.expr(f"before div {int(window)}").alias("window"), "before", "doc_id", "tokens")
    return windows.repartition(parts_n, "window").sortWithinPartitions("window", "before").mapInArrow(packed, schema)


def write_packs(packs: DataFrame, folder: str) -> DataFrame:
    """Write the rows of ``pack_tokens`` as binary files and return their index.

    ``folder``: a path or URI that pyarrow's file systems and Spark both reach from
    every executor; a local path only where Spark runs on one machine. Of each
    task's rows there are four files: ``K.ids`` and ``K.positions``, row after row
    as in ``packs``; ``K.cu``, the cumulative lengths of all rows as little-endian
    32-bit integers; ``K.cu_at``, 64-bit: for each row the place in ``K.cu`` where
    its lengths begin, and the end of the last. The index, written last to
    ``index``, has a row for each packed row: pack_id, file (K), row (its place in
    the files), n_used, doc_ids, parts. A task writes under a name of its attempt
    and moves the files when they are whole, so one that runs again, or runs
    twice, leaves the same files. Empty input gives no files and an empty index.
    """
    kept = ["pack_id", "n_used", "doc_ids", "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, at = TaskContext.get(), 0, 0
        name = f"{task.partitionId():06d}"
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")
        store.create_dir(base, recursive=True)
        drafts = {kind: f"{base}/_{name}.{task.taskAttemptId()}.{kind}" for kind in ("ids", "positions", "cu", "cu_at")}
        with ExitStack() as opened:
            files = {kind: opened.enter_context(store.open_output_stream(path)) for kind, path in drafts.items()}
            files["cu_at"].write(np.array([0], "<i8").tobytes())
            for b in batches:
                for ids, positions, cu in zip(*(b.column(c).to_pylist() for c in ("ids", "positions", "cu_seqlens")), strict=True):
                    at += len(cu)
                    for kind, raw in zip(files, (ids, positions, np.array(cu, "<i4").tobytes(), np.array([at], "<i8").tobytes()), strict=True):
                        files[kind].write(raw)
                places = pa.array(range(row, row + b.num_rows), pa.int64())
                row += b.num_rows
                columns = [*(b.column(c) for c in kept), pa.array([name] * b.num_rows, pa.string()), places]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "file", "row"])
        for kind, path in drafts.items():
            if row:
                store.move(path, f"{base}/{name}.{kind}")
            else:
                store.delete_file(path)

    index = packs.mapInArrow(run, "pack_id long, n_used int, doc_ids array<long>, parts array<int>, file string, row long")
    index.write.parquet(f"{folder}/index")
    return packs.sparkSession.read.parquet(f"{folder}/index")
