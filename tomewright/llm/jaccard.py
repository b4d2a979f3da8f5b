"""N-gram Jaccard join: all sets of shingles that overlap enough, exactly.

Two sets that overlap enough share one of the few first elements of each, in any
common order of elements; here the order is from rare to common by a fixed-size
count of all elements. The sets that have an element, ordered by size, fall into
runs in which neighbours may link by their sizes; a set alone in its run is done.
A run's home is its smallest set, so runs of the same sets share a home and a set
has few. The sets of a home are one group; groups too large for one tile are cut
into cells of a band of sizes. Bitmaps, whose differing bits bound the overlap from
above, tell which sets of a tile may link; only these are sent again with their
elements, compared exactly and joined on the spot. What leaves a tile is a spanning
forest of links, never the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import Shared, components, id_and_text, may_be_in, partitions, text_key
from tomewright.llm.shingles import folded, parity_bits, set_name, shingle_sets

#: Counters of element frequency; their number is fixed, so what is broadcast is too.
COUNTERS = 1 << 16
#: Names of sets that a task remembers, so that it signs copies once.
SEEN = 1_000_000
#: Elements (of 8 bytes) of a tile's sets, where each set counts as LEAST at least.
CELL = 4_000_000
LEAST = 2048
#: Sets of a large group that every cell of it is held against first.
LEADERS = 16


def _counted(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, s in shingle_sets(b.column(1), words):
                at = (s >> np.uint64(48)).astype(np.int64)
                if len(s) > 20_000:
                    total += np.bincount(at, minlength=COUNTERS)
                else:
                    np.add.at(total, at, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])

    return run


def _rarest(s: np.ndarray, percent: int, weight: np.ndarray) -> np.ndarray:
    """The elements of which a set that links with ``s`` must have one. Ties at
    the last place go by hash, so that the order is one for all sets."""
    n = len(s)
    k = n - -(-percent * n // 100) + 1
    if k >= n:
        return s
    w = weight[(s >> np.uint64(48)).astype(np.int64)]
    top = np.partition(w, k - 1)[k - 1]
    sure = np.flatnonzero(w < top)
    return s[np.concatenate([sure, np.flatnonzero(w == top)[: k - len(sure)]])]


def _signed(words: int, percent: int, commonness):
    """Of each text the size and name of its set; of the first text of a set in
    this task also the parity bitmap and the rarest elements."""
    names = ["doc_id", "text_hash", "n", "sid", "check", "bits", "first"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = commonness.value, set()
        for b in batches:
            rows = [[0, None, None, None, None] for _ in range(b.num_rows)]
            for i, s in shingle_sets(b.column(1), words):
                if len(s):
                    name = set_name(s)
                    rows[i][:3] = len(s), *name
                    if name not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(name)
                        rows[i][3:] = parity_bits(s), _rarest(s, percent, weight).view(np.int64)
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return run


def _runs(percent: int):
    """From (tok, n, sid) in that order the sets of each run with more than one,
    and the run's home. One pass, one row of memory: an element that very many
    sets have needs no room. Runs at the ends of the partition may go on in the
    next: their rows are kept and marked, 1 in the first run, 2 the last row."""
    names = ["home", "sid", "n", "tok", "part", "edge"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None

        def batch(home, sid, n, tok, edge) -> pa.RecordBatch:
            cols = [home, sid, n.astype(np.int32), tok, np.full(len(sid), part, np.int32), edge.astype(np.int32)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

        for b in batches:
            tok, n, sid = (b.column(i).to_numpy().astype(np.int64) for i in range(3))
            if last is not None:  # the row whose successor wasn't known yet
                tok, n, sid = (np.concatenate([[x], y]) for x, y in zip(last[:3], (tok, n, sid), strict=True))
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
            tok, n, sid = tok[new], n[new], sid[new]
            if not len(tok):
                continue
            near = np.zeros(len(tok), bool)
            near[1:] = (tok[1:] == tok[:-1]) & (100 * n[:-1] >= percent * n[1:])
            at = np.maximum.accumulate(np.where(near, 0, np.arange(len(tok))))
            home, first = sid[at], at == 0
            if last is not None:
                near[0] = last[3]
                home[first], first = last[4], first & last[5]
            held = near | first
            held[:-1] |= near[1:]
            held[-1] = False
            if held.any():
                yield batch(*(x[held] for x in (home, sid, n, tok, first)))
            last = tuple(x[-1] for x in (tok, n, sid, near, home, first))
        if last is not None:
            yield batch(*(np.array([x]) for x in (last[4], last[2], last[1], last[0], 2 + int(last[5]))))

    return scan


def _joined_runs(held: DataFrame, percent: int) -> DataFrame:
    """(home, sid, n) with the homes of runs that go over several partitions made
    one. A row for each partition comes to the driver, and as many go back."""
    first, final = (F.col("edge").bitwiseAND(k) > 0 for k in (1, 2))
    ends = held.where("edge > 0").groupBy("part").agg(
        F.min(F.when(first, F.struct("n", "tok", "home"))).alias("first"), F.max(F.when(final, F.struct("n", "tok", "home"))).alias("last"), F.max(F.when(final, first)).alias("whole")
    )
    moved, before = [], None
    for r in sorted(ends.collect()):
        home = r.last.home
        if before and r.first and before[0] == r.first.tok and 100 * before[1] >= percent * r.first.n:
            moved.append((r.part, before[2]))
            home = before[2] if r.whole else home
        before = r.last.tok, r.last.n, home
    if moved:
        over = held.sparkSession.createDataFrame(moved, "part int, over long").withColumn("edged", F.lit(1))
        held = held.withColumn("edged", first.cast("int")).join(F.broadcast(over), ["part", "edged"], "left").withColumn("home", F.coalesce("over", "home"))
    return held.groupBy("home", "sid").agg(F.min("n").alias("n"))


def _views(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], some: int) -> Iterator[pa.Table]:
    """Tables of equal keys, from rows sorted by them and, within, residents before
    visitors. Where the visitors of a tile are more than ``some`` bytes, the tile
    comes several times, with other visitors each time: what a task holds is
    bounded by the residents, of which a cell has at most about CELL elements."""
    held: list[pa.RecordBatch] = []
    stay, guests, last = 0, 0, None  # batches of residents; bytes of visitors
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[:, i].tolist())
            if key != last:
                if held:
                    yield pa.Table.from_batches(held)
                held, stay, guests = [], 0, 0
            last = key
            piece = b.slice(i, j - i)
            visit = piece.column(b.schema.get_field_index("visit")).to_numpy(zero_copy_only=False)
            first = int(np.argmax(visit)) if visit.any() else len(visit)
            if first:
                held.append(piece.slice(0, first))
                stay += 1
            for at in range(first, len(visit), 256):
                guest = piece.slice(at, 256)
                if guests and guests + guest.nbytes > some:
                    yield pa.Table.from_batches(held)
                    held, guests = held[:stay], 0
                held.append(guest)
                guests += guest.nbytes
    if held:
        yield pa.Table.from_batches(held)


def _possible(n: np.ndarray, bits: list[np.ndarray], comp: np.ndarray, visit: np.ndarray, percent: int, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows, with their differing bits, that sizes and bitmaps leave
    possible, of different components. Two visitors meet in their own cells; in
    the later pass two residents have met."""
    width = np.array([len(x) for x in bits])
    for size in np.unique(width):
        own = np.flatnonzero(width == size)
        cols = np.concatenate([own, np.flatnonzero((width > size) & (percent * n <= 100 * n[own].max()))])
        signs = np.stack([folded(bits[i], size) for i in cols])
        some = max(1, 4_000_000 // int(size))
        for k in range(0, len(own), 64):
            a, order = own[k : k + 64, None], np.arange(k, min(k + 64, len(own)))[:, None]
            x, y = n[a], n[cols]
            fits = (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & (comp[a] != comp[cols]) & (np.arange(len(cols)) > order)
            fits &= (visit[a] != visit[cols]) if later else ~(visit[a] & visit[cols])
            i, j = np.nonzero(fits)
            for q in range(0, len(i), some):
                u, v = i[q : q + some] + k, j[q : q + some]
                differ = np.bitwise_count(signs[u] ^ signs[v]).sum(axis=1, dtype=np.int64)
                ok = differ * (100 + percent) <= (n[cols[u]] + n[cols[v]]) * (100 - percent)
                yield cols[u[ok]], cols[v[ok]], differ[ok]


def _distinct(group: pa.Table) -> pa.Table:
    """One row for each set; where it is resident and visitor, the resident."""
    sid, visit = group["sid"].to_numpy(), group["visit"].to_numpy()
    by = np.lexsort((visit, sid))
    first = np.ones(len(by), bool)
    first[1:] = sid[by][1:] != sid[by][:-1]
    return group.take(pa.array(np.sort(by[first]))).combine_chunks()


KEYS = ["home", "band", "salt"]


def _flagged(percent: int, later: bool, some: int):
    """The rows of each tile that may link with another row of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, KEYS, some):
            group = _distinct(group)
            n, comp, visit = (group[c].to_numpy() for c in ("n", "comp", "visit"))
            flag = np.zeros(len(n), bool)
            for x, y, _ in _possible(n.astype(np.int64), _views(group["bits"], np.uint64), comp, visit, percent, later):
                flag[x] = flag[y] = True
            if flag.any():
                yield from group.select([*KEYS, "sid", "comp", "visit"]).filter(pa.array(flag)).to_batches()

    return run


def _built(words: int):
    """The elements of the wanted sets, from texts that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            check = b.column(1).to_pylist()
            at, elements = [], []
            for i, s in shingle_sets(b.column(0), words):
                if len(s) and set_name(s)[1] == check[i]:
                    at.append(i)
                    elements.append(s.tobytes())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(2).take(take), pa.array(elements, pa.binary()), b.column(3).take(take)], names=["sid", "elements", "tiles"])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _linked(percent: int, later: bool, some: int):
    """A spanning forest of the links of each tile: pairs in the order of their
    differing bits, each compared exactly unless the two are joined already."""

    def links(group: pa.Table) -> Iterator[tuple[int, int]]:
        sid, comp, visit = (group[c].to_numpy() for c in ("sid", "comp", "visit"))
        sets = _views(group["elements"], np.uint64)
        n = np.array([len(s) for s in sets])
        bits = [np.frombuffer(parity_bits(s), np.uint64) for s in sets]
        pairs = list(_possible(n, bits, comp, visit, percent, later))
        if not pairs:
            return
        x, y, differ = (np.concatenate(c) for c in zip(*pairs, strict=True))
        by = np.argsort(differ, kind="stable")
        x, y = x[by], y[by]
        root = np.unique(comp, return_inverse=True)[1]  # rows of one component are one from the start
        while len(x):
            for i, j in zip(x[:500].tolist(), y[:500].tolist(), strict=True):
                if root[i] != root[j]:
                    shared = _overlap(sets[i], sets[j])
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        root[root == root[j]] = root[i]
                        yield int(sid[i]), int(sid[j])
            apart = root[x[500:]] != root[y[500:]]
            x, y = x[500:][apart], y[500:][apart]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, KEYS, some):
            if found := list(links(_distinct(group))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["u", "v"])

    return run


def _joined_tiles(rows: DataFrame, light: DataFrame, texts: DataFrame, words: int, percent: int, later: bool, shared: Shared) -> DataFrame:
    """The links (u, v) of tiles of rows (home, band, salt, sid, n, comp, visit)."""
    spark = rows.sparkSession
    tiles = rows.join(light.select("sid", "bits"), "sid").select(*KEYS, "sid", "n", "comp", "visit", "bits")
    tiles = tiles.repartition(*KEYS).sortWithinPartitions(*KEYS, "visit")
    flags = tiles.mapInArrow(_flagged(percent, later, 8 * CELL), "home long, band int, salt int, sid long, comp long, visit boolean")
    tile = F.struct(*KEYS, "comp", "visit")
    wanted = flags.groupBy("sid").agg(F.collect_set(tile).alias("tiles")).join(light, "sid")
    # written, so that its true size decides how the texts are joined
    wanted = shared.keep(wanted.select("sid", "check", "tiles", F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("text_hash")))
    texts, _ = may_be_in(texts, text_key("doc_id", "text_hash"), wanted, text_key("at_id", "text_hash"))
    found = texts.join(wanted, (texts["text_hash"] == wanted["text_hash"]) & texts["doc_id"].eqNullSafe(wanted["at_id"]))
    kind = "array<struct<home: bigint, band: int, salt: int, comp: bigint, visit: boolean>>"
    built = found.select("text", "check", "sid", "tiles").mapInArrow(_built(words), f"sid long, elements binary, tiles {kind}")
    full = built.select(F.explode("tiles").alias("t"), "sid", "elements").select("t.*", "sid", "elements")
    full = full.repartition(partitions(spark), *KEYS).sortWithinPartitions(*KEYS, "visit")
    links = shared.keep(full.mapInArrow(_linked(percent, later, 8 * CELL), "u long, v long"))
    shared.drop(wanted)
    return links


def _band(percent: int) -> Column:
    """Sets that may link lie in one band of sizes or in neighbours, or by
    rounding at the edges two apart."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) - F.lit(1e-9)).cast("int")


def _links(seats: DataFrame, light: DataFrame, texts: DataFrame, words: int, percent: int, shared: Shared) -> DataFrame:
    """Links that join what belongs together, of the groups ``seats(home, sid, n)``.

    Cells of a large group, and its leaders against all of them, come first. Then
    what is not in its largest component visits every cell within reach."""
    weight = F.sum(F.greatest("n", F.lit(LEAST)))
    sizes = seats.groupBy("home").agg(F.count(F.lit(1)).alias("k"), weight.alias("w")).where("k > 1").drop("k")
    sizes = shared.keep(sizes)  # so that a join by a home of very many sets can be split
    members = shared.keep(seats.join(sizes, "home").withColumn("band", F.when(F.col("w") > CELL, _band(percent)).otherwise(-1)))
    large = members.where("band >= 0")
    cells = large.groupBy("home", "band").agg(F.ceil(weight / CELL).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("sid"), "salts").cast("int")
    own = F.col("sid").alias("comp")
    resident = F.lit(False).alias("visit")
    small = members.where("band < 0").select("home", "band", F.lit(0).alias("salt"), "sid", "n", own, resident)
    if large.isEmpty():
        return _joined_tiles(small, light, texts, words, percent, False, shared)
    cells = shared.keep(cells)
    seated = shared.keep(large.join(cells, ["home", "band"]).select("home", "band", salt.alias("salt"), "sid", "n"))
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    reach = F.explode(F.array(*(F.col("band") + d for d in range(-2, 3)))).alias("band")

    def visiting(rows: DataFrame) -> DataFrame:
        there = rows.select("home", "sid", "n", "comp", reach).join(cells, ["home", "band"])
        return there.select("home", "band", every, "sid", "n", "comp", F.lit(True).alias("visit"))

    lead = large.groupBy("home", F.pmod(F.xxhash64("sid"), F.lit(LEADERS)).alias("k")).agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "n", "band")).alias("s"))
    lead = visiting(lead.select("home", "s.sid", "s.n", "s.band").withColumn("comp", F.col("sid")))
    first = small.unionByName(seated.select("*", own, resident)).unionByName(lead)
    links = _joined_tiles(first, light, texts, words, percent, False, shared)
    settled = components(links, shared).withColumnRenamed("node", "sid")
    now = shared.keep(seated.join(settled, "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component"))
    most = now.groupBy("home", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("home").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("n_comps"))
    open_ = now.join(most.where("n_comps > 1"), "home")
    rows = open_.select(*now.columns, resident).unionByName(visiting(open_.where("comp <> most")))
    return links.unionByName(_joined_tiles(rows, light, texts, words, percent, True, shared))


def _named_apart(signed: DataFrame) -> DataFrame:
    """``signed`` with another name for a set whose 64-bit name a different one has."""
    twice = signed.where("sid is not null").groupBy("sid").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo < hi").select("sid", "lo")
    if twice.isEmpty():
        return signed
    other = F.when(F.col("check") != F.col("lo"), F.xxhash64("sid", "check")).otherwise(F.col("sid"))
    return signed.join(twice, "sid", "left").withColumn("sid", other).select(*signed.columns)


def _grouped(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str, shared: Shared) -> DataFrame:
    """(doc_id, text_hash, n, component_id, component_hash) for every row of ``docs``;
    the last two are of the first row of the component."""
    spark = docs.sparkSession
    texts = id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    counts = texts.mapInArrow(_counted(words), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    weight = np.zeros(COUNTERS, np.int64)
    for r in counts.collect():  # at most COUNTERS rows
        weight[r.counter] = r.n
    sent = spark.sparkContext.broadcast(weight)
    schema = "doc_id long, text_hash long, n int, sid long, check long, bits binary, first array<long>"
    signed = _named_apart(shared.keep(texts.mapInArrow(_signed(words, percent, sent), schema)))
    elements = signed.where("first is not null").select(F.explode("first").alias("tok"), "n", "sid")
    dealt = elements.repartitionByRange(partitions(spark), "tok", "n", "sid").sortWithinPartitions("tok", "n", "sid")
    held = shared.keep(dealt.mapInArrow(_runs(percent), "home long, sid long, n int, tok long, part int, edge int"))
    seats = shared.keep(_joined_runs(held, percent))
    shared.drop(held)
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    light = signed.where("bits is not null").join(seats.select("sid").distinct(), "sid", "left_semi")
    light = shared.keep(light.groupBy("sid").agg(place.alias("at"), F.first("check").alias("check"), F.first("bits").alias("bits")))
    ids = shared.keep(signed.select("doc_id", "text_hash", "n", "sid"))
    shared.drop(signed)
    settled = components(_links(seats, light, texts, words, percent, shared), shared)
    shared.only(ids, settled)
    reps = ids.where("sid is not null").groupBy("sid").agg(place.alias("at"))
    both = reps.join(settled.withColumnRenamed("node", "sid"), "sid")
    least = both.groupBy("component").agg(F.min("at").alias("least"))
    of_set = reps.join(settled.withColumnRenamed("node", "sid"), "sid", "left").join(least, "component", "left")
    out = ids.join(of_set.select("sid", F.coalesce("least", "at").alias("at")), "sid", "left")
    alone = F.col("sid").isNull()
    return out.select(
        "doc_id", "text_hash", "n",
        F.when(alone, F.col("doc_id")).otherwise(F.col("at.doc_id")).alias("component_id"),
        F.when(alone, F.col("text_hash")).otherwise(F.col("at.text_hash")).alias("component_hash"),
    )


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Two documents link when 100 * intersection >= ``percent`` * union of their
    distinct ``words``-word shingles; component_id is the smallest doc_id
    reachable by links. Texts without words have no set and link with nothing;
    their component is their own id. Rows with a null id count for sets and
    links, also where only they connect others, but give no component its name.
    Rows that repeat an id count each with its own text. Equal sets are one set
    from the start, so copies cost nothing further. Shingles are compared by
    64-bit hashes, sets by 128-bit names. A text is read whole, and its set must
    fit a task.
    """
    out = _grouped(docs, words, percent, id_col, text_col, Shared(docs.sparkSession))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of smallest id, and of
    several texts with that id the one of smallest hash. Rows with a null id and
    texts without words stay; rows equal in id and text are one document and
    stay or go together."""
    shared = Shared(docs.sparkSession)
    groups = _grouped(docs, words, percent, id_col, text_col, shared)
    gone = groups.where("doc_id is not null and n > 0 and not (doc_id <=> component_id and text_hash = component_hash)")
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = shared.keep(gone)
    shared.only(gone)
    doc_id, text_hash = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    some, rest = may_be_in(docs, text_key(doc_id, text_hash), gone, text_key("_id", "_hash"))
    return rest.unionByName(some.join(gone, (doc_id == F.col("_id")) & (text_hash == F.col("_hash")), "left_anti"))
