"""The k nearest rows of one distributed table for every row of another, and the index that serves it.

The index deals the base's vectors into tiles, one row each: the vectors of a part of a cell, packed, and
beside them their codes. A code names, for each pair of dimensions, the nearest of 256 residuals from the
cell's centroid; with the length of what the code leaves out, it bounds the distance to any question
from below. Questions are packed the same way, and tiles meet tiles in two rounds:

1. a block of questions meets the cells nearest to its own. Distances by codes pick ``k`` rows per question,
   which are measured; the largest distance is the question's bound, as no k-th hit lies beyond it;
2. a block meets every tile of the cells that the bounds do not exclude by the triangle inequality. Codes are
   looked up in tables of distances, and vectors are measured only where the code's lower bound passes.

Bounds only pass over what cannot be a hit, so the result is exact. No question or vector passes through the
driver: it holds the centroids and code books, whose number is a parameter, trained on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.operators.vectors import _all_pairs, _matrix, _pairwise, _rank_order, _slack
from chunkloom.session import materialize

#: Bytes of blocks that are dealt out at once, and vectors of the sample for each cell.
DEALT = 16 << 20
PER_CELL = 128


@dataclass(frozen=True)
class TileParams:
    """``rows`` vectors per tile and ``asks`` questions per block at most, give or take a hash's spread; ``cells`` centroids
    at most, fitted with the code books on at most ``sample`` vectors; the first round looks into ``probes`` cells; ``codes``
    off measures every vector of a tile that is met."""

    rows: int = 4096
    asks: int = 1024
    cells: int = 64
    sample: int = 20_000
    probes: int = 2
    codes: bool = True
    width: int = 2


@dataclass(frozen=True)
class Quantizer:
    """Centroids, and per part of ``width`` dimensions a book of residuals (empty without codes)."""

    centroids: np.ndarray
    books: np.ndarray  # parts x entries x width

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out (rounded up)."""
        parts, entries, width = self.books.shape
        codes = np.empty((len(residuals), parts), np.uint8)
        off = np.zeros(len(residuals))
        for j, book in enumerate(self.books):
            piece = residuals[:, j * width : (j + 1) * width]
            codes[:, j] = _all_pairs(piece, book, "l2").argmin(axis=1)
            off += ((piece - book[codes[:, j]]) ** 2).sum(1)
        return codes, np.sqrt(off) * (1 + 1e-9) + 1e-12

    def looked_up(self, residuals: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of questions (residuals from the cell's centroid) to coded rows, from tables per part."""
        parts, _, width = self.books.shape
        total = np.zeros((len(residuals), len(codes)))
        asked = residuals.reshape(len(residuals), parts, width)
        tables = (asked**2).sum(2)[:, :, None] + (self.books**2).sum(2)[None] - 2 * np.einsum("qpw,pew->qpe", asked, self.books)
        for j in range(parts):
            total += tables[:, j][:, codes[:, j]]
        return np.sqrt(np.maximum(total, 0.0))


def _means(rows: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means on a bounded sample; fewer rows than ``k`` are their own means."""
    draw = np.random.default_rng(seed)
    found = np.unique(rows, axis=0)
    if len(found) <= k:
        return found
    means = found[np.sort(draw.choice(len(found), k, replace=False))]
    for _ in range(rounds):
        at = _all_pairs(rows, means, "l2").argmin(axis=1)
        count = np.bincount(at, minlength=k)
        sums = np.zeros_like(means)
        np.add.at(sums, at, rows)
        means = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], means)
    return means


def train_quantizer(base: DataFrame, p: TileParams = TileParams(), id_col: str = "id") -> Quantizer:
    """Fitted on the ``p.sample`` rows with the smallest hashes of their ids; only these reach the driver."""
    drawn = base.orderBy(F.xxhash64(id_col), id_col).select("embedding").limit(p.sample).toArrow()
    if not drawn.num_rows:
        return Quantizer(np.zeros((0, 0)), np.zeros((0, 0, p.width)))
    column = drawn.column("embedding").combine_chunks()
    rows = _matrix(column, len(column[0]))
    centroids = _means(rows, max(1, min(p.cells, len(rows) // PER_CELL)), 1)
    if not p.codes:
        return Quantizer(centroids, np.zeros((0, 0, p.width)))
    rest = rows - centroids[_all_pairs(rows, centroids, "l2").argmin(axis=1)]
    rest = np.pad(rest, ((0, 0), (0, -rest.shape[1] % p.width)))
    books = [_means(rest[:, j : j + p.width], 256, j) for j in range(0, rest.shape[1], p.width)]
    books = [np.concatenate([b, np.repeat(b[:1], 256 - len(b), axis=0)]) for b in books]
    return Quantizer(centroids, np.stack(books))


@dataclass(frozen=True)
class VectorIndex:
    """``tiles``: cell, part, ids, vectors, codes, left (what the codes leave out); per cell the number of tiles and the radius."""

    tiles: DataFrame
    quantizer: Quantizer
    parts: dict[int, int]
    radii: dict[int, float]
    params: TileParams


def _celled(rows: DataFrame, id_col: str, quantizer: Quantizer, size: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """(id, embedding, cell, part): rows dealt into parts of about ``size`` per cell; parts and radius per cell."""
    centroids = quantizer.centroids

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column("embedding"), centroids.shape[1])
                cell = _all_pairs(vectors, centroids, "l2").argmin(axis=1)
                far = _pairwise(vectors, centroids[cell], "l2")
                yield pa.record_batch([batch.column("id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "embedding", "cell", "far"])

    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(near, "id long, embedding array<double>, cell int, far double")
    rows = materialize(rows, "celled")
    found = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row per cell
    parts = {r.cell: -(-r.n // size) for r in found}
    per_cell = F.lit([parts.get(c, 1) for c in range(max(len(centroids), 1))])
    part = F.pmod(F.xxhash64("id"), F.get(per_cell, F.col("cell"))).cast("int")
    return rows.withColumn("part", part), parts, {r.cell: r.far for r in found}


def build_index(base: DataFrame, p: TileParams = TileParams(), id_col: str = "id", quantizer: Quantizer | None = None) -> VectorIndex:
    """Tiles of all rows, written to the shared folder. Ids are whole numbers; a repeated id stays several rows."""
    quantizer = quantizer or train_quantizer(base, p, id_col)
    rows, parts, radii = _celled(base, id_col, quantizer, p.rows)

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        vectors = _matrix(table.column("embedding").combine_chunks(), quantizer.centroids.shape[1])
        cell = table.column("cell")[0].as_py()
        codes, left = np.zeros((0, 0), np.uint8), np.zeros(0)
        if p.codes:
            codes, left = quantizer.encode(_padded(vectors - quantizer.centroids[cell], p.width))
        blobs = (table.column("id").to_numpy(), vectors, codes, left)
        return pa.table(
            {"cell": pa.array([cell], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int32())}
            | {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("ids", "vectors", "codes", "left"), blobs, strict=True)}
        )

    tiles = rows.groupBy("cell", "part").applyInArrow(pack, "cell int, part int, ids binary, vectors binary, codes binary, left binary")
    return VectorIndex(materialize(tiles, "tiles"), quantizer, parts, radii, p)


def _padded(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % width)))


def _blocks_of(rows: DataFrame, dims: int) -> DataFrame:
    """Questions packed by (cell, part): cell, asks, asked, bounds."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        blobs = (table.column("id").to_numpy(), _matrix(table.column("embedding").combine_chunks(), dims), table.column("bound").to_numpy())
        names = ("asks", "asked", "bounds")
        return pa.table({"own": pa.array([table.column("cell")[0].as_py()], pa.int32())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(names, blobs, strict=True)})

    return rows.groupBy("cell", "part").applyInArrow(pack, "own int, asks binary, asked binary, bounds binary")


def passing(asked: np.ndarray, bounds: np.ndarray, vectors: np.ndarray, quantizer: Quantizer, cell: int, codes: np.ndarray, left: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (question, row) of a block and a tile that have to be measured."""
    if len(left):
        centre = quantizer.centroids[cell]
        coded = quantizer.looked_up(_padded(asked - centre, width), codes)
        low, high = coded - left[None, :], coded + left[None, :]
    else:
        low = high = _all_pairs(asked, vectors, "l2")
    if k < high.shape[1]:
        bounds = np.minimum(bounds, np.partition(high, k - 1, axis=1)[:, k - 1])
    return np.nonzero(low <= bounds[:, None] + _slack(asked, vectors, "l2", bounds))


def _met(pairs: DataFrame, index: VectorIndex, k: int, first: bool) -> DataFrame:
    """(query_id, id, distance): the at most ``k`` best rows of each question of a block in each tile."""
    quantizer, p, dims = index.quantizer, index.params, index.quantizer.centroids.shape[1]
    parts = quantizer.books.shape[0]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asks = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["asks"], np.int64)
                vectors = np.frombuffer(row["vectors"]).reshape(-1, dims)
                asked, bounds = np.frombuffer(row["asked"]).reshape(-1, dims), np.frombuffer(row["bounds"])
                left, codes = np.frombuffer(row["left"]), np.frombuffer(row["codes"], np.uint8).reshape(len(ids) if parts else 0, parts)
                if first and len(left) and len(ids) > k:  # any k rows give a bound: those nearest by code
                    coded = quantizer.looked_up(_padded(asked - quantizer.centroids[row["cell"]], p.width), codes)
                    base = np.argpartition(coded, k - 1, axis=1)[:, :k].ravel()
                    rows = np.repeat(np.arange(len(asked)), k)
                else:
                    rows, base = passing(asked, bounds, vectors, quantizer, row["cell"], codes, left, k, p.width)
                dist = _pairwise(asked[rows], vectors[base], "l2")
                keep = _rank_order(rows, np.round(dist, 9), ids[base], k) if len(rows) else rows
                keep = keep[dist[keep] <= bounds[rows[keep]] + 1e-9 * (1 + bounds[rows[keep]])]
                yield pa.record_batch([pa.array(asks[rows[keep]]), pa.array(ids[base[keep]]), pa.array(dist[keep])], names=["query_id", "id", "distance"])

    # Spark takes the dealt blocks for small, as it cannot see into them; broadcast, all of them would pass through the driver.
    met = pairs.join(index.tiles.hint("merge"), ["cell", "part"])
    return met.mapInArrow(measure, "query_id long, id long, distance double")


def _dealt(blocks: DataFrame, index: VectorIndex, wanted) -> DataFrame:
    """A row (cell, part, block) for each tile of the cells ``wanted(own, asked, bounds)``."""
    parts, dims = index.parts, index.quantizer.centroids.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                asked, bounds = np.frombuffer(row["asked"]).reshape(-1, dims), np.frombuffer(row["bounds"])
                cells = [int(c) for c in wanted(row["own"], asked, bounds)]
                for cell in cells:
                    n = parts[cell]
                    step = max(1, DEALT // (len(row["asked"]) + 1))
                    for lo in range(0, n, step):
                        part = range(lo, min(n, lo + step))
                        block = batch.slice(at, 1).take(pa.array([0] * len(part))).select(["asks", "asked", "bounds"])
                        yield pa.record_batch([pa.array([cell] * len(part), pa.int32()), pa.array(part, pa.int32()), *block.columns], names=["cell", "part", *block.schema.names])

    return blocks.mapInArrow(deal, "cell int, part int, asks binary, asked binary, bounds binary")


def _best(rows: DataFrame, k: int) -> DataFrame:
    rounded = F.round("distance", 9)  # ties go by id
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(rounded, "id"))).where(F.col("rank") <= k)


def nearest_in_index(index: VectorIndex, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, id, distance, rank``: the exact k nearest rows by l2 of the index for each question (query_id, embedding).

    ``query_id`` is a unique whole number. Fewer than ``k`` rows in the base give fewer hits; ties go by id. Runs the jobs
    of the first round; no question passes through the driver.
    """
    spark = queries.sparkSession
    cells = np.array(sorted(index.parts), dtype=np.int64)
    if not len(cells):
        return _nothing(spark)
    every, probes = index.quantizer.centroids, index.params.probes
    centroids = every[cells]
    radii = np.array([index.radii[c] for c in cells])
    asked, _, _ = _celled(queries, "query_id", index.quantizer, index.params.asks)
    dims = centroids.shape[1]

    def nearby(own: int, _asked: np.ndarray, _bounds: np.ndarray) -> np.ndarray:
        apart = _all_pairs(every[own : own + 1], centroids, "l2")[0]
        return cells[np.argsort(apart, kind="stable")[:probes]]

    def within(_own: int, asked: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        apart = _all_pairs(asked, centroids, "l2")
        slack = 1e-6 * (1 + np.abs(asked).max(initial=0.0) + np.abs(centroids).max(initial=0.0))
        return cells[(apart <= bounds[:, None] + radii[None, :] + slack).any(axis=0)]

    first = _blocks_of(asked.withColumn("bound", F.lit(float("inf"))), dims)
    first = _best(_met(_dealt(first, index, nearby), index, k, True), k)
    bounds = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("bound"))
    bounds = materialize(bounds.where(F.col("n") >= k).select(F.col("query_id").alias("id"), "bound"), "bounds")
    second = asked.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    return _best(_met(_dealt(_blocks_of(second, dims), index, within), index, k, False), k)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query_id long, id long, distance double, rank int")


def nearest_join(base: DataFrame, queries: DataFrame, k: int, p: TileParams = TileParams(codes=False), id_col: str = "id") -> DataFrame:
    """``nearest_in_index`` over an index built for the purpose: both tables are distributed, of any size."""
    return nearest_in_index(build_index(base, p, id_col), queries, k)
