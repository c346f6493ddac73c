"""Operator 13, whitening of embeddings by a covariance computed in tiles.

Entries become integers x = floor(64 * entry) + 1000000, so that sums are exact.
The model is fitted on the distinct x vectors. Their dimensions are cut into
blocks of ``TILE`` columns and every pair of blocks is a tile of the covariance.
Each block of rows sends, for each tile, its two centred column blocks to the
tile's key; tasks multiply them and add the products up by tile, and the tiles'
partial sums are added once more. No task holds more than some tiles and one
block of rows; only the assembled matrix, whose size depends on the dimensions
alone, reaches the driver, which takes its eigenvectors.

Distinct vectors are combined before they are shuffled, so a vector that many
rows share needs no task of its own. The fit list is written, since blocks of
rows must be the same ones when a task is repeated.

Defined results: rows whose vector is null or holds a null or non-finite entry
go, and so do empty vectors and those with another number of entries than most
rows have (of equally frequent numbers the larger is taken); entries for which
64 * entry is 2**45 or more in size count as of that size; repeated rows and null
ids each get their rows; extra columns are ignored. Components whose eigenvalue
is zero to double precision can't be whitened and are left out, so there are
fewer than 16 then, and a fit list of one vector, or an empty table, gives no rows.
``deviation`` is null where it doesn't fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SCALE, SHIFT = 64, 1_000_000
#: Columns of a block; a tile has the square of it.
TILE = 32
#: Rows and entries of a block of rows, at most.
BLOCK_ROWS, BLOCK_ENTRIES = 4096, 1 << 21
COMPONENTS = 16
#: Size of the largest integer that an entry becomes, less the shift: two such sizes still differ exactly in a double.
LARGEST = 1 << 45


def integer_vectors(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows remain, and their entries as integers x - SHIFT (rows x dims). Without ``dims`` only the first, and each row's number of entries."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    values = column.flatten()  # without what null rows may cover
    entries = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    ends = np.cumsum(sizes)
    keep = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    if dims is None:
        return keep, sizes
    keep &= sizes == dims
    rows = entries[((ends - sizes)[keep][:, None] + np.arange(dims)).ravel()]
    with np.errstate(over="ignore"):
        return keep, np.clip(np.floor(SCALE * rows), -LARGEST, LARGEST).astype(np.int64).reshape(-1, dims)


@dataclass(frozen=True)
class Centre:
    """The fit list's number of vectors and its sums (of x - SHIFT), exact."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, z: np.ndarray) -> np.ndarray:
        """n * x - S of rows, exact: long, or Python's integers where a long might not do."""
        most = max(int(np.abs(z).max(initial=0)), 1) * self.n + max(abs(s) for s in self.sums)
        kind = np.int64 if most < 1 << 62 else object
        return z.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, z: np.ndarray) -> np.ndarray:
        return (self.scaled(z) / self.n).astype(np.float64)

    def deviations(self, z: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2; None beyond a long."""
        y = self.scaled(z)
        about = (y.astype(np.float64) ** 2).sum(axis=1) / 2.0**63
        if y.dtype == object:
            out = [None] * len(y)
        else:  # a long's wrap-around is exact for sums that fit a long
            out = [d if a < 1 - 1e-6 else None for d, a in zip((y * y).sum(axis=1).tolist(), about.tolist(), strict=True)]
        for k in np.flatnonzero((about < 1 + 1e-6) & ((about >= 1 - 1e-6) | (y.dtype == object))).tolist():
            d = sum(v * v for v in y[k].tolist())
            out[k] = d if d < 1 << 63 else None
        return out


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The vectors of a written fit list, some thousand rows at once."""
    for batch in batches:
        if batch.num_rows:
            whole = np.asarray(batch.column("z").flatten()).reshape(batch.num_rows, -1)
            rows = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // whole.shape[1]))
            for a in range(0, len(whole), rows):
                yield whole[a : a + rows]


def fit_list(vectors: DataFrame, dims: int) -> DataFrame:
    """z (x - SHIFT) of each distinct vector once, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, z = integer_vectors(batch.column("embedding"), dims)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * dims, pa.int32()), pa.array(z.ravel()))], ["z"])

    return shared.written(vectors.select("embedding").mapInArrow(run, "z array<long>").distinct(), "whitening-fit")


def dimensions(vectors: DataFrame) -> int:
    """The number of entries that most usable vectors have; 0 if there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            keep, sizes = integer_vectors(batch.column("embedding"))
            for size, n in zip(*np.unique(sizes[keep], return_counts=True), strict=True):
                found[int(size)] = found.get(int(size), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["size", "n"])

    counts = vectors.select("embedding").mapInArrow(run, "size long, n long").groupBy("size").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), F.desc("size")).first()
    return int(top["size"]) if top else 0


def centre(fit: DataFrame, dims: int) -> Centre:
    """Exact count and sums: high and low halves are summed apart, so that no long overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for z in row_blocks(batches):
            n += len(z)
            high += (z >> 24).sum(axis=0)
            low += (z & ((1 << 24) - 1)).sum(axis=0)
        columns = [np.append(np.arange(dims), -1), np.append(high, 0), np.append(low, n)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "high", "low"])

    big = "decimal(38,0)"
    rows = fit.mapInArrow(run, "dim long, high long, low long").groupBy("dim").agg(F.sum(F.col("high").cast(big)).alias("high"), F.sum(F.col("low").cast(big)).alias("low")).collect()
    found = {r["dim"]: (int(r["high"]) << 24) + int(r["low"]) for r in rows}
    return Centre(found.get(-1, 0), tuple(found.get(k, 0) for k in range(dims)))


def tiled_product(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray], width: int, tile: int = TILE) -> np.ndarray:
    """The sum over the fit list of p p', where p = project(z) has ``width`` entries, by tiles.

    Every block of rows sends both column blocks of each tile, which is what a
    join of column blocks by block of rows would give.
    """
    blocks = range(0, width, tile)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, z in enumerate(row_blocks(batches)):
            p = np.ascontiguousarray(project(z))
            columns = {a: p[:, a : a + tile].tobytes() for a in blocks}
            for a in blocks:
                for first in range(a, width, 8 * tile):
                    others = range(first, min(width, first + 8 * tile), tile)
                    m = len(others)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([a] * m, pa.int32()), pa.array(list(others), pa.int32()), pa.array([(task << 32) + k] * m, pa.int64()), pa.array([len(p)] * m, pa.int32()), pa.array([columns[a]] * m, pa.binary()), pa.array([columns[b] if b > a else None for b in others], pa.binary())],
                        ["a", "b", "row_block", "n", "left", "right"],
                    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            a, b, n, left, right = (batch.column(c) for c in ("a", "b", "n", "left", "right"))
            for k in range(batch.num_rows):
                key = (a[k].as_py(), b[k].as_py())
                x = np.frombuffer(left[k].as_buffer()).reshape(n[k].as_py(), -1)
                y = np.frombuffer(right[k].as_buffer()).reshape(n[k].as_py(), -1) if right[k].is_valid else x
                sums[key] = sums.get(key, 0) + x.T @ y
        yield tiles(sums)

    def tiles(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in sums], pa.int32()), pa.array([b for _, b in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["a", "b", "product"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, product in zip(*(batch.column(c) for c in ("a", "b", "product")), strict=True):
                key = (a.as_py(), b.as_py())
                sums[key] = sums.get(key, 0) + np.frombuffer(product.as_buffer())
        yield tiles(sums)

    schema = "a int, b int, product binary"
    dealt = fit.mapInArrow(deal, "a int, b int, row_block long, n int, left binary, right binary").repartition("a", "b", "row_block")
    found = dealt.mapInArrow(multiply, schema).repartition("a", "b").mapInArrow(add, schema).collect()  # one row for each tile
    out = np.zeros((width, width))
    for r in found:
        a, b = r["a"], r["b"]
        block = np.frombuffer(bytes(r["product"])).reshape(min(tile, width - a), min(tile, width - b))
        out[a : a + len(block), b : b + block.shape[1]] = block
        out[b : b + block.shape[1], a : a + len(block)] = block.T
    return out


@dataclass(frozen=True)
class Whitening:
    """centre, and of each component the vector over the root of its eigenvalue (a column) and its share of the variance."""

    centre: Centre
    weights: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Whitening | None:
    """Fit on the distinct vectors of ``vectors`` (embedding); None if nothing varies."""
    dims = dimensions(vectors)
    if not dims:
        return None
    listed = fit_list(vectors, dims)
    middle = centre(listed, dims)
    v = tiled_product(listed, middle.centred, dims, tile) / middle.n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(values)[::-1]
    order = order[values[order] > max(values.max(), 0) * dims * np.finfo(float).eps][:components]
    if not len(order):
        return None
    weights = axes[:, order] / np.sqrt(values[order])
    covariance = tiled_product(listed, lambda z: middle.centred(z) @ weights, len(order), tile) / middle.n
    shared.discard(listed)
    return Whitening(middle, weights, values[order] / np.trace(v), float(np.abs(covariance - np.eye(len(order))).max()))


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """Every usable row of ``vectors`` (vec_id, embedding) by component."""
    spark = vectors.sparkSession
    model = fit(vectors, components, tile)
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    held = spark.sparkContext.broadcast(model)  # a column of weights for each component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = held.value
        dims, k = m.weights.shape
        for batch in batches:
            keep, z = integer_vectors(batch.column("embedding"), dims)
            ids = batch.column("vec_id").filter(pa.array(keep)).cast(pa.int64())
            for a in range(0, len(z), BLOCK_ROWS):
                rows = z[a : a + BLOCK_ROWS]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(a, a + n), k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), pa.array(np.full(n * k, m.centre.n), pa.int64()),
                        pa.array(m.centre.deviations(rows), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))), pa.array((m.centre.centred(rows) @ m.weights).ravel()),
                        pa.array(np.tile(m.explained, n)), pa.array(np.full(n * k, m.identity_error)),
                    ],
                    SCHEMA.replace(",", "").split()[::2],
                )

    return vectors.select("vec_id", "embedding").mapInArrow(run, SCHEMA)
