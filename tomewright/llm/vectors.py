"""Vectors of near directions: an exact range join by pivots.

On unit vectors, cosine >= t is Euclidean distance <= r = sqrt(2 - 2t). Each
vector lives in the cell of its nearest pivot. By the triangle inequality a
vector can only be near one of another cell if it lies within r of the plane
between the two pivots, and within r of the ball that holds that cell; to those
cells it is sent as a guest. Cells are then joined one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomewright.llm.common import Shared, components

#: Room for rounding in the bounds; pairs this near the threshold are computed again.
SLACK = 1e-9
#: The same for distances, which are roots of differences of cosines.
ROOT_SLACK = 1e-7


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dimension and doubles of each usable vector; dimension 0 for others."""
    for b in batches:
        dims, raw = [], []
        for v in b.column(2):
            x = None if not v.is_valid else v.values
            ok = x is not None and len(x) and not x.null_count
            x = x.to_numpy(zero_copy_only=False).astype(np.float64) if ok else None
            ok = ok and np.isfinite(x).all() and np.any(x)
            with np.errstate(over="ignore", under="ignore"):
                if ok and not 1e-200 < np.dot(x, x) < np.inf:
                    # a power of two changes no cosine, and the norm then fits a double
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
            dims.append(len(x) if ok else 0)
            raw.append(np.ascontiguousarray(x).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["row", "vec_id", "dim", "raw"])


def _pairs(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (raw) have a cosine of ``least``."""
    ln, rn = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    lu, ru = left / ln[:, None], right / rn[:, None]
    out = np.zeros((len(left), len(right)), bool)
    for k in range(0, len(left), 512):
        cos = lu[k : k + 512] @ ru.T
        out[k : k + 512] = cos >= least
        for i, j in zip(*np.nonzero(np.abs(cos - least) < SLACK), strict=True):
            out[k + i, j] = np.dot(left[k + i], right[j]) / (ln[k + i] * rn[j]) >= least
    return out


def _roots(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each left and right row reaches over ``linked``."""
    i, j = np.nonzero(linked)
    left, right = left.copy(), right.copy()
    while True:
        before = left.sum(dtype=object), right.sum(dtype=object)
        np.minimum.at(left, i, right[j])
        np.minimum.at(right, j, left[i])
        if before == (left.sum(dtype=object), right.sum(dtype=object)):
            return left, right


def near_vectors(
    vectors: DataFrame, least: float = 0.9, cell_rows: int = 4096, most_pivots: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    n_links: rows with cosine >= ``least`` in double precision, itself not
    counted; component_id: the smallest id reachable; kept: vec_id = component_id.
    Vectors that are null, empty, zero or hold null or non-finite components, and
    rows with null id, link with nothing; vectors of different lengths don't
    link. Equal vectors link like others.

    A pivot for each ``cell_rows`` rows, at most ``most_pivots`` for a dimension,
    is drawn by hash; pivots and cell figures are all that is broadcast. Cells are
    joined in tiles of at most about 2 * ``cell_rows`` rows, so a cell of any size
    is spread over tasks. Within a tile only counts and the smallest reachable id
    leave, never pairs. Data without any structure can't be pruned by distances;
    then every cell sees most rows.
    """
    spark = vectors.sparkSession
    shared = Shared(spark)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    )
    rows = shared.keep(rows.mapInArrow(_checked, "row long, vec_id long, dim int, raw binary"))
    usable = rows.where("dim > 0 and vec_id is not null")
    pivots: dict[int, np.ndarray] = {}
    for dim, n in usable.groupBy("dim").count().collect():
        k = min(most_pivots, -(-n // cell_rows))
        drawn = usable.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "raw"), "row").limit(k).select("raw").collect()
        units = _units([bytes(r.raw) for r in drawn])
        pivots[dim] = units[np.sort(np.unique(np.round(units, 12), axis=0, return_index=True)[1])]  # equal ones once

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(b.schema.get_field_index("dim")).to_numpy()
            raw = b.column(b.schema.get_field_index("raw"))
            cells, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                cos = _units(raw.take(pa.array(at)).to_pylist()) @ pivots[int(dim)].T
                cells[at] = cos.argmax(axis=1)
                far[at] = np.sqrt(np.maximum(0, 2 - 2 * cos.max(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    homes = shared.keep(usable.mapInArrow(home, "row long, vec_id long, dim int, raw binary, cell int, far double"))
    cells = {(r.dim, r.cell): (r.n, r.radius) for r in homes.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    reach = float(np.sqrt(2 - 2 * least)) + SLACK

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A vector's own cell, and those of lower number it may reach."""
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            dims, own = col["dim"].to_numpy(), col["cell"].to_numpy()
            at_all, cell_all = [np.arange(len(dims))], [own]
            for dim in np.unique(dims):
                p, at = pivots[int(dim)], np.flatnonzero(dims == dim)
                cos = _units(col["raw"].take(pa.array(at)).to_pylist()) @ p.T
                radius = np.array([cells.get((int(dim), c), (0, -np.inf))[1] for c in range(len(p))])
                used, which = np.unique(own[at], return_inverse=True)
                apart = np.stack([np.linalg.norm(p - p[c], axis=1) for c in used])
                plane = cos[np.arange(len(at)), own[at]][:, None] - cos
                near = plane <= reach * apart[which] + SLACK
                near &= np.sqrt(np.maximum(2 - 2 * cos, 0)) - radius <= reach + ROOT_SLACK
                near &= np.arange(len(p)) < own[at][:, None]
                i, c = np.nonzero(near)
                at_all.append(at[i])
                cell_all.append(c)
            at, cell = np.concatenate(at_all), np.concatenate(cell_all).astype(np.int32)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [col["dim"].take(take), pa.array(cell), pa.array(own[at] == cell), col["row"].take(take), col["vec_id"].take(take), col["raw"].take(take)],
                names=["dim", "cell", "home", "row", "vec_id", "raw"],
            )

    seated = shared.keep(homes.mapInArrow(seats, "dim int, cell int, home boolean, row long, vec_id long, raw binary"))
    sizes = seated.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("home").alias("h"))
    blocks = lambda c: F.ceil(F.col(c) / cell_rows).cast("int")
    spread = seated.join(F.broadcast(sizes.select("dim", "cell", blocks("n").alias("bn"), blocks("h").alias("bh"))), ["dim", "cell"])
    salt = F.xxhash64("row")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = spread.where("home").select("*", F.lit(True).alias("left"), F.pmod(salt, "bh").cast("int").alias("i"), upto("bn").alias("j"))
    right = spread.select("*", F.lit(False).alias("left"), upto("bh").alias("i"), F.pmod(salt, "bn").cast("int").alias("j"))

    def tile(group: pa.Table) -> pa.Table:
        is_left = group["left"].to_numpy()
        side = [group.filter(pa.array(is_left)), group.filter(pa.array(~is_left))]
        found = {"row": [], "vec_id": [], "n": [], "root": []}
        if side[0].num_rows and side[1].num_rows:
            raw = [np.frombuffer(b"".join(s["raw"].to_pylist()), np.float64).reshape(s.num_rows, -1) for s in side]
            row, ids = [s["row"].to_numpy() for s in side], [s["vec_id"].to_numpy() for s in side]
            linked = _pairs(raw[0], raw[1], least)
            # two of this cell meet once; a guest meets all of them
            linked &= ~side[1]["home"].to_numpy()[None, :] | (row[1][None, :] > row[0][:, None])
            if linked.any():
                for k, root in enumerate(_roots(linked, *ids)):
                    n = linked.sum(axis=1 - k)
                    for name, x in zip(found, (row[k], ids[k], n, root), strict=True):
                        found[name].append(x[n > 0])
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for k, v in found.items()})

    tiles = left.unionByName(right).select("dim", "cell", "i", "j", "left", "home", "row", "vec_id", "raw")
    part = shared.keep(tiles.groupBy("dim", "cell", "i", "j").applyInArrow(tile, "row long, vec_id long, n long, root long"))
    shared.drop(homes, seated)
    links = part.groupBy("row").agg(F.sum("n").alias("n_links"))
    joined = components(part.select(F.col("vec_id").alias("u"), F.col("root").alias("v")), shared)
    out = rows.select("row", "vec_id").join(links, "row", "left").join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
