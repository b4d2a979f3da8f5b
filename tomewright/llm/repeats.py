"""Removal of repeated passages, with suffix arrays over buckets of the corpus.

Two equal passages of ``length`` bytes hold the same smallest hash of all their
``GRAM``-byte strings. Cutting every text into pieces of places whose passages
share that hash, and keying the pieces by it, sends all equal passages to one
bucket. Keys that only one place has are done; the pieces of the others are
fetched, equal pieces become one, and the suffix array of each run of buckets
finds the passages that different pieces share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import Shared, id_and_text, may_be_in, partitions, text_key
from tomewright.llm.rolling import BASE, byte_chunks, hashes, mix, sums
from tomewright.llm.suffixes import common_prefixes, keys, suffix_array

GRAM = 32
#: Symbols in one suffix array; buckets are never split between arrays.
ARRAY = 1 << 20
#: Distinct pieces of one bucket that go into one array; the passages of larger
#: buckets are dealt anew, by their outer bytes.
BUCKET = 20_000
#: Bytes at each end of a passage by which a large bucket is dealt anew.
OUTER = 24
#: Rows of one key that go to one task; of more, each part goes to another first.
HOT = 20_000
#: Digests of texts that a task remembers, so that it cuts copies once.
SEEN = 1_000_000


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from minima that run forwards and
    backwards inside blocks."""
    n = len(h) - width + 1
    blocks = -(-len(h) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _cut(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first passage, key) of each piece of one text; the last piece ends with
    the last passage. A new piece begins where the smallest hash changes, or
    where its place is passed."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = min(GRAM, length)
    place = np.arange(len(data) - gram + 1)
    h = hashes(sums(data), place, place + gram)
    least = _window_minima(h, length - gram + 1)
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1])
    at = np.flatnonzero(new)
    return at, least[at].view(np.int64)


def _own_repeats(raw: bytes, at: np.ndarray, key: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which pieces of one text to keep, and the spans of those that stand in it
    before, byte for byte; neighbouring spans as one."""
    keep, spans = np.ones(len(at), bool), []
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    seen = set()
    for i in np.flatnonzero(times[back] > 1).tolist():
        start, end = int(at[i]), int(at[i] + size[i]) + length - 1
        piece = raw[start:end]
        if piece not in seen:
            seen.add(piece)
            continue
        keep[i] = False
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
    return keep, spans


def _cuts(length: int):
    """The pieces of each text that the task meets first: name, key, first passage
    and their number. Pieces that a text holds again are ``again``, with the bytes
    they cover: rows that are done, and so have a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            names = b.column(0).to_numpy()
            for first, data, offsets in byte_chunks(b.column(1)):
                out: list[list[np.ndarray]] = [[], [], [], [], []]
                for r, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), first):
                    if j - i < length:
                        continue
                    raw = data[i:j].tobytes()
                    digest = hashlib.blake2b(raw, digest_size=16).digest()
                    if digest in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(digest)
                    at, key = _cut(data[i:j], length)
                    size = np.diff(at, append=j - i - length + 1)
                    keep, spans = _own_repeats(raw, at, key, size, length)
                    done = np.array(spans, np.int64).reshape(-1, 2)
                    own = mix(done[:, 0].astype(np.uint64) + names[r : r + 1].view(np.uint64) * np.full(1, BASE, np.uint64)).view(np.int64)
                    for o, x, y in zip(out[1:], (key[keep], at[keep], size[keep], np.zeros(int(keep.sum()), bool)), (own, done[:, 0], done[:, 1] - done[:, 0], np.ones(len(done), bool)), strict=True):
                        o += [x, y]
                    out[0].append(np.full(int(keep.sum()) + len(done), names[r]))
                if out[0]:
                    cols = [np.concatenate(o) for o in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4])],
                        names=["name", "key", "start", "n", "again"],
                    )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, name and start those whose key isn't alone, and those
    that are done. The same place of copies of one text is one. One row waits for
    its successor; a key that very many have needs no room. A key at an end of the
    partition may go on in the next, so its rows stay."""
    last, linked, first_key = None, True, None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        name, key, start = (b.column(i).to_numpy() for i in range(3))
        first_key = key[0] if first_key is None else first_key
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (name[1:] == name[:-1]) & (start[1:] == start[:-1])
        fresh = np.flatnonzero(~same)
        b, key = b.take(pa.array(fresh)), key[fresh]
        again = b.column(4).to_numpy(zero_copy_only=False)
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        same[0] = linked
        keep = same | again | (key == first_key)
        keep[:-1] |= same[1:]
        keep[-1] = False
        if keep.any():
            yield b.filter(pa.array(keep))
        last, linked = b.slice(len(key) - 1), bool(same[-1])
    if last is not None:
        yield last


def _pieces(length: int):
    """The bytes of the wanted pieces of each text: doc_id, name, text and found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found = b.column(0).to_pylist(), b.column(2)
            names = b.column(3).to_pylist()
            for first, data, offsets in byte_chunks(b.column(1)):
                out: list[list] = [[], [], [], [], []]
                for r, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), first):
                    raw = data[i:j].tobytes()
                    key, start, size = (found[r].values.field(k).to_numpy() for k in range(3))
                    out[0] += [ids[r]] * len(key)
                    out[4] += [names[r]] * len(key)
                    out[1].append(key)
                    out[2].append(start)
                    out[3] += [raw[s : s + n + length - 1] for s, n in zip(start.tolist(), size.tolist(), strict=True)]
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[0], pa.int64()), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]).astype(np.int32)), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int64())],
                        names=["doc_id", "key", "start", "piece", "name"],
                    )

    return run


def repeated_in(pieces: list[bytes], doc: np.ndarray, name: np.ndarray, start: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(name, from, to) of passages of ``pieces`` that an earlier one holds too.
    ``doc``, ``name`` and ``start`` say where the first occurrence of each piece
    stands; they come in this order."""
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    symbols = np.zeros(int(ends[-1]), np.uint16)
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    symbols[:] = data.astype(np.uint16) + 1
    symbols[ends - 1] = 0
    key = keys(symbols)
    order = suffix_array(symbols, length, key)
    shared = common_prefixes(order, key, length) >= length
    # a passage and its class: neighbours in the order that share a full passage
    of_class = np.concatenate([[0], np.cumsum(~shared)])
    grouped = np.zeros(len(order), bool)
    grouped[1:] |= shared
    grouped[:-1] |= shared
    place, of_class = order[grouped], of_class[grouped]
    piece = np.searchsorted(ends, place, "right")
    whole = place + length < ends[piece]  # not over a separator
    place, of_class, piece = place[whole], of_class[whole], piece[whole]
    at = start[piece] + place - begin[piece]
    by = np.lexsort((at, name[piece], doc[piece], of_class))
    later = np.zeros(len(by), bool)
    later[1:] = of_class[by][1:] == of_class[by][:-1]
    gone = by[later]
    if not len(gone):
        return []
    piece, at = piece[gone], at[gone]
    by = np.lexsort((at, piece))
    piece, at = piece[by], at[by]
    cut = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(cut[1:], len(at)) - 1
    return [(int(name[piece[i]]), int(at[i]), int(at[j]) + length) for i, j in zip(cut, last, strict=True)]


def _passages(key: int, piece: bytes, length: int, outer: int) -> Iterator[tuple[int, int, bytes]]:
    """(place, key, passage) of each passage of a piece, under a new key made of
    the old one and ``outer`` bytes of each end, which equal passages share."""
    old = key.to_bytes(8, "little", signed=True)
    for i in range(len(piece) - length + 1):
        one = piece[i : i + length]
        digest = hashlib.blake2b(old + one[:outer] + one[-outer:], digest_size=8).digest()
        yield i, int.from_bytes(digest, "little", signed=True), one


def _dealt(length: int, outer: int):
    """Pieces (key, piece, doc_id, name, start) as their passages under new keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                cols: list[list] = [[] for _ in range(5)]
                for key, piece, doc, name, start in zip(*(c.to_pylist() for c in b.slice(k, 1000).columns), strict=True):
                    for i, new, one in _passages(key, piece, length, outer):
                        for c, v in zip(cols, (new, one, doc, name, start + i), strict=True):
                            c.append(v)
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "piece", "doc_id", "name", "start"])

    return run


def _scan(length: int, most: int, outer: int):
    """From pieces sorted by key, bytes, doc_id, name and start: the spans of pieces
    that stood before, and those that suffix arrays find, over runs of whole
    buckets. A bucket of over ``most`` pieces goes out again passage by passage,
    under keys of their outer bytes. Of a bucket that is here only in part (the
    sixth column) the first of equal pieces goes out again under its own key."""
    names, kinds = ["name", "from", "to", "doc_id", "key", "piece"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def dealt(key: int, piece: bytes, doc: int, name: int, start: int) -> list[tuple]:
        return [(name, start + i, start + i + length, doc, new, one) for i, new, one in _passages(key, piece, length, outer)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # distinct pieces of finished buckets with more than one
        now: list[tuple] = []  # those of the bucket at hand
        out: list[tuple] = []
        key = before = place = None
        size, over = 0, False

        def found(rows: list[tuple]) -> list[tuple]:
            doc, name, start = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
            return [(*x, None, None, None) for x in repeated_in([r[0] for r in rows], doc, name, start, length)]

        for b in batches:
            for k, piece, doc, name, start, part in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    if len(now) > 1:
                        done += now
                        size += sum(len(r[0]) + 1 for r in now)
                    now, key, before, over = [], k, None, False
                    if size >= ARRAY:
                        out += found(done)
                        done, size = [], 0
                if piece == before:
                    if (name, start) != place:  # else one row given twice
                        out.append((name, start, start + len(piece), None, None, None))
                elif part is not None:
                    out.append((name, start, start + len(piece), doc, k, piece))
                elif over:
                    out += dealt(k, piece, doc, name, start)
                else:
                    now.append((piece, doc, name, start))
                    if len(now) > most:
                        for r in now:
                            out += dealt(k, *r)
                        now, over = [], True
                before, place = piece, (name, start)
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
        if len(now) > 1:
            done += now
        if done:
            out += found(done)
        if out:
            yield batch(out)

    return run


def _rest(length: int):
    """Each text without its spans."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                rest, removed, runs = _without(raw, [(x["from"], x["to"]) for x in spans.as_py()])
                for c, v in zip(cols, (removed, runs, hashlib.sha256(rest).hexdigest(), rest, rest.decode("utf-8", "ignore")), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "name", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])

    return run


def _crowded(rows: DataFrame, n: int) -> DataFrame:
    """(key, parts) of keys that very many of ``n`` rows have: at most 100,000."""
    most = max(HOT, n // 100_000)
    count = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return count.select("key", F.ceil(F.col("n") / most).cast("int").alias("parts"))


def _found(pieces: DataFrame, hot: DataFrame, length: int, shared: Shared) -> DataFrame:
    """(name, from, to) of all passages of ``pieces`` that stand earlier.

    The pieces of a ``hot`` key are dealt by row over several tasks, where equal
    ones become one; what is left goes on by its key. A key that still has very
    many pieces, so different ones, goes on passage by passage, under keys of their
    outer bytes, and if need be of all their bytes. So each round leaves fewer rows of
    a key, and no task must hold or stream a key that grows with the corpus.
    """
    found = "name long, from int, to int, doc_id long, key long, piece binary"
    cols, outer, spans = ["key", "piece", "doc_id", "name", "start"], OUTER, None
    while True:
        part = F.pmod(F.xxhash64("name", "start"), "parts").alias("part")
        rows = pieces.join(F.broadcast(hot), "key", "left").select(*cols, part).repartition("key", "part").sortWithinPartitions(*cols)
        out = shared.keep(rows.mapInArrow(_scan(length, BUCKET, outer), found))
        shared.drop(pieces)
        each = out.where("piece is null").select("name", "from", "to")
        spans = each if spans is None else spans.unionByName(each)
        left = out.where("piece is not null").withColumnRenamed("from", "start").select(*cols)
        n = left.count()
        if not n:
            return spans
        wide = shared.keep(_crowded(left.join(F.broadcast(hot.select("key")), "key", "left_semi"), n).select("key"))
        shared.drop(hot)
        pieces = left
        if not wide.isEmpty():
            dealt = left.join(F.broadcast(wide), "key", "left_semi").select(*cols).mapInArrow(_dealt(length, outer), left.schema)
            pieces = shared.keep(left.join(F.broadcast(wide), "key", "left_anti").select(*cols).unionByName(dealt))
            shared.drop(wide)
        hot = shared.keep(_crowded(pieces, n))
        outer = length


def _spans(texts: DataFrame, facts: DataFrame, length: int, shared: Shared) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, name) of the texts that may lose a part, and (name, spans). Of equal texts
    only the first is searched; the others go whole or stay whole."""
    schema = "name long, key long, start int, n int, again boolean"
    cuts = texts.select("name", "text").mapInArrow(_cuts(length), schema)
    order = ["key", "name", "start"]
    dealt = cuts.repartitionByRange(partitions(texts.sparkSession), *order).sortWithinPartitions(*order)
    hits = shared.keep(dealt.mapInArrow(_shared, schema))
    lists = hits.groupBy("name").agg(F.collect_set(F.when(~F.col("again"), F.struct("key", "start", "n"))).alias("found"))
    own = shared.keep(hits.where("again").select("name", F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to")))
    first = facts.groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    held = shared.keep(texts.join(lists.join(first, "name"), ["name", "doc_id"]).select("doc_id", "text", "found", "name"))
    counted = shared.keep(_crowded(hits.where("not again"), hits.count()))
    shared.drop(hits)
    pieces = held.mapInArrow(_pieces(length), "doc_id long, key long, start int, piece binary, name long")
    spans = _found(pieces, counted, length, shared)
    lists = spans.unionByName(own).groupBy("name").agg(F.collect_list(F.struct("from", "to")).alias("spans"))
    return held.select("doc_id", "text", "name"), lists


def _apart(facts: DataFrame) -> list[int]:
    """Names that two different texts share; of 64-bit names these are very few."""
    twice = facts.groupBy("name").agg(F.min("sha256").alias("lo"), F.max("sha256").alias("hi")).where("lo < hi")
    return [r.name for r in twice.select("name").collect()]


def _searched(all_texts: DataFrame, length: int, shared: Shared) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """Facts of every row with an id, among them the first id that has its text and
    whether it is a later copy; what ``_spans`` gives; whether rows repeat."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    sha = F.sha2(raw, 256)
    texts = all_texts.where("doc_id is not null").withColumn("name", F.xxhash64(raw))
    fact = lambda t: t.select("doc_id", "name", F.xxhash64("text").alias("text_hash"), F.octet_length(raw).alias("n_bytes"), sha.alias("sha256"))
    facts = shared.keep(fact(texts))
    if twice := _apart(facts):
        texts = texts.withColumn("name", F.when(F.col("name").isin(twice), F.xxhash64(sha)).otherwise(F.col("name")))
        shared.drop(facts)
        facts = shared.keep(fact(texts))
    held, lists = _spans(texts, facts, length, shared)
    repeated = not facts.groupBy("doc_id", "name").count().where("count > 1").isEmpty()
    first = facts.groupBy("name").agg(F.min("doc_id").alias("first_id"))
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= length)
    return facts.join(first, "name").withColumn("copy", copy), held, lists, repeated


def remove_repeats(docs: DataFrame, length: int = 100, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text_hash, kept, kept_text]) for every row.

    Texts are UTF-8 bytes (null: none). Each byte that a ``length``-byte string
    covers which also starts earlier, in a document of smaller id or further
    front in its own, is removed, judged on the input; matches never cross
    documents. ``kept`` is what remains, as bytes, and null where nothing was
    removed; ``kept_text`` the same without characters that a cut has split;
    ``text_hash``, xxhash64 of the text, tells which of several rows of an id is
    meant. Rows with a null id are passed through whole. Different texts of one id
    are documents of their own, in the order of their hashes; rows equal in id and
    text count as one. Equal texts are found by hash and SHA-256. A text is read
    whole and must fit a task; empty tables give no rows.
    """
    shared = Shared(docs.sparkSession)
    all_texts = id_and_text(docs, id_col, text_col)
    facts, held, lists, repeated = _searched(all_texts, length, shared)
    cut = held.join(lists, "name").select("doc_id", "text", "spans", "name")
    cut = cut.mapInArrow(_rest(length), "doc_id long, name long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string").drop("doc_id")
    if not keep_text:
        cut = cut.drop("kept", "kept_text")
    if repeated:
        cut = cut.dropDuplicates(["name"])
    out = facts.join(cut, "name", "left")
    copy = F.col("copy")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    cols = [
        F.col("doc_id"),
        F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(copy, F.col("n_bytes").cast("long")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(copy, empty).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if keep_text:
        cols.append(F.col("text_hash"))
        cols.append(F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
        cols.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    nameless = all_texts.where("doc_id is null").select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
        *([F.xxhash64("text").alias("text_hash"), F.lit(None).cast("binary").alias("kept"), F.lit(None).cast("string").alias("kept_text")] if keep_text else []),
    )
    return out.select(*cols).unionByName(nameless)


def _without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """``raw`` without its spans, the bytes removed and the runs they form."""
    kept, removed, runs, end = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > end or not runs:
            kept.append(raw[end:a])
            runs += 1
            end = a
        removed += max(0, b - end)
        end = max(end, b)
    return b"".join([*kept, raw[end:]]), removed, runs


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what ``remove_repeats`` keeps of each text, and without the rows
    of which nothing is left. A row is changed by the result of its own id and
    text only; rows that lose nothing, also null ids and empty texts, are as they
    were. Of the rows, only those that lose something are shuffled."""
    shared = Shared(docs.sparkSession)
    facts, _, lists, repeated = _searched(id_and_text(docs, id_col, text_col), length, shared)
    lost = facts.join(lists, "name", "left").where("copy or spans is not null")
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("copy").alias("_copy"), F.col("spans").alias("_spans"))
    lost = shared.keep(lost.dropDuplicates(["_id", "_hash"]) if repeated else lost)
    shared.only(lost)
    place = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for text, copy, spans in zip(b.column(place), b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
                text, spans = text.as_py(), [(x["from"], x["to"]) for x in spans.as_py() or []]
                if spans and not copy.as_py():
                    text = _without(text.encode("utf-8", "surrogatepass"), spans)[0].decode("utf-8", "ignore")
                texts.append(text)
                keep.append(not copy.as_py() and not (spans and not text))
            cols = list(b.columns[:-2])
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    doc_id, text_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    some, rest = may_be_in(docs, text_key(doc_id, text_hash), lost, text_key("_id", "_hash"))
    some = some.join(lost, (doc_id == F.col("_id")) & (text_hash == F.col("_hash")), "left").drop("_id", "_hash")
    return rest.unionByName(some.mapInArrow(cut, docs.schema))
