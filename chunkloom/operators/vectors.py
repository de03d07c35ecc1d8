"""Nearest-vector joins: exact, and over the cells of a coarse quantizer.

The base table is scanned once in place. Each task keeps the ``k`` best rows per query
while it reads its Arrow batches, so what is shuffled is at most ``queries x k`` rows per
task, however the vectors are spread. A product of matrices only preselects, with a margin for its
rounding; ranks go by distances computed pair by pair, ties by id, so the result does not
depend on batches or partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("l2", "cosine", "dot")
# Queries sent to the tasks at once, as numbers of rows and values; a larger query table
# is answered in several blocks of that size.
BLOCK_ROWS = 20_000
BLOCK_VALUES = 4_000_000
# Distances of a tile, and values of pairs that are measured, at a time: each is held in a few matrices at once.
_TILE_VALUES = 500_000


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dims:
        raise ValueError(f"expected vectors of {dims} values; filter the table with check_dims first")
    return flat.astype(np.float64).reshape(len(column), dims)


def _all_pairs(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of a block by one matrix product; exact up to rounding noise."""
    product = q @ v.T
    if metric == "dot":
        return -product
    if metric == "cosine":
        scale = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
        return 1.0 - np.divide(product, scale, out=np.zeros_like(product), where=scale > 0)
    square = (q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2.0 * product
    return np.sqrt(np.maximum(square, 0.0))


def _slack(q: np.ndarray, v: np.ndarray, metric: str, bound: np.ndarray) -> np.ndarray:
    """How far a distance by matrix product may be off, per query: rounding grows with the vectors' length."""
    eps = 8 * np.finfo(float).eps * q.shape[1]
    longest = np.sqrt((v * v).sum(1).max(initial=0.0))
    length = np.sqrt((q * q).sum(1))
    if metric == "cosine":
        return np.full((len(q), 1), 2 * eps)
    if metric == "dot":
        return (2 * eps * length * longest)[:, None]
    off = eps * (length + longest) ** 2  # of the squares; both sides of the comparison may be off
    near = np.where(np.isfinite(bound), bound, 0.0)
    return (np.sqrt(near**2 + 2 * off) - near + np.sqrt(2 * off) * (near**2 <= 2 * off))[:, None]


def _pairwise(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of aligned rows, the value that is reported."""
    if metric == "dot":
        return -(q * v).sum(1)
    if metric == "cosine":
        scale = np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1))
        return 1.0 - np.divide((q * v).sum(1), scale, out=np.zeros(len(q)), where=scale > 0)
    return np.sqrt(((q - v) ** 2).sum(1))


def _rank_order(rows: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best entries per query row, grouped by query row."""
    order = np.lexsort((ids, dist, rows))
    ranked = rows[order]
    first = np.r_[0, np.flatnonzero(np.diff(ranked)) + 1]
    place = np.arange(len(ranked)) - np.repeat(first, np.diff(np.r_[first, len(ranked)]))
    return order[place < k]


class _TopK:
    """The k best base rows per query over the batches of one task."""

    def __init__(self, queries: np.ndarray, k: int, metric: str, id_col: str, probes: np.ndarray | None):
        self.queries, self.k, self.metric, self.id_col, self.probes = queries, k, metric, id_col, probes
        self.bound = np.full(len(queries), np.inf)
        self.rows = np.empty(0, np.int64)
        self.dist = np.empty(0)
        self.kept: pa.Table | None = None

    def _ids(self, table: pa.Table) -> np.ndarray:
        ids = table.column(self.id_col).to_numpy()
        return ids.astype(str) if ids.dtype == object else ids

    def _candidates(self, vectors: np.ndarray, cells: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Query and base rows that may be among the best; errs on the side of keeping."""
        step = max(1, _TILE_VALUES // max(1, len(vectors)))
        found = []
        for at in range(0, len(self.queries), step):
            dist = _all_pairs(self.queries[at : at + step], vectors, self.metric)
            if cells is not None:
                dist[~self.probes[at : at + step][:, cells]] = np.inf
            bound = self.bound[at : at + step]
            if self.k < dist.shape[1]:
                bound = np.minimum(bound, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
            slack = _slack(self.queries[at : at + step], vectors, self.metric, bound)
            query, base = np.nonzero((dist <= bound[:, None] + slack) & (dist < np.inf))
            found.append((query + at, base))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def add(self, payload: pa.Table, vectors: np.ndarray, cells: np.ndarray | None) -> None:
        rows, base = self._candidates(vectors, cells)
        if not len(rows):
            return
        # The survivors per batch are cut to k before they are joined to the pool.
        dist = np.empty(len(rows))
        step = max(1, _TILE_VALUES // max(1, vectors.shape[1]))
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            dist[part] = _pairwise(self.queries[rows[part]], vectors[base[part]], self.metric) + 0.0
        keep = _rank_order(rows, dist, self._ids(payload)[base], self.k)
        rows, dist, table = rows[keep], dist[keep], payload.take(pa.array(base[keep]))
        if self.kept is not None:
            rows, dist = np.r_[self.rows, rows], np.r_[self.dist, dist]
            table = pa.concat_tables([self.kept, table])
            keep = _rank_order(rows, dist, self._ids(table), self.k)
            rows, dist, table = rows[keep], dist[keep], table.take(pa.array(keep))
        self.rows, self.dist, self.kept = rows, dist, table.combine_chunks()
        full = np.bincount(rows, minlength=len(self.queries)) >= self.k
        worst = np.full(len(self.queries), -np.inf)
        np.maximum.at(worst, rows, dist)
        self.bound = np.where(full, worst, np.inf)


def _scan(
    base: DataFrame,
    query_ids: pa.Array,
    queries: np.ndarray,
    query_type: T.DataType,
    k: int,
    metric: str,
    id_col: str,
    probes: np.ndarray | None,
) -> DataFrame:
    payload = [c for c in base.columns if c not in ("embedding", "cell")]
    dims = queries.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _TopK(queries, k, metric, id_col, probes)
        for batch in batches:
            if batch.num_rows:
                cells = None if probes is None else batch.column("cell").to_numpy()
                table = pa.Table.from_batches([batch]).select(payload)
                top.add(table, _matrix(batch.column("embedding"), dims), cells)
        if top.kept is not None:
            columns = [query_ids.take(pa.array(top.rows)), pa.array(top.dist)]
            columns += [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in top.kept.columns]
            out = pa.Table.from_arrays(columns, ["query_id", "distance", *payload])
            yield from out.to_batches(max_chunksize=10_000)

    schema = T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("distance", T.DoubleType()),
            *[base.schema[c] for c in payload],
        ]
    )
    return base.mapInArrow(best, schema)


def _blocks(queries: DataFrame) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The query table in blocks of bounded size. Runs one job for a usual request."""
    pairs = queries.select("query_id", "embedding")
    some = pairs.limit(BLOCK_ROWS + 1).toArrow()
    if not some.num_rows:
        return
    dims = len(some.column("embedding")[0])
    block = min(BLOCK_ROWS, max(1, BLOCK_VALUES // dims))
    if some.num_rows <= block:
        tables = iter([some])
    else:
        # Hash blocks are even to within a few per cent; half the bound leaves room.
        count = -(-2 * pairs.count() // block)
        part = F.pmod(F.xxhash64("query_id"), F.lit(count))
        tables = (pairs.filter(part == i).toArrow() for i in range(count))
    for found in tables:
        if found.num_rows:
            found = found.combine_chunks()
            vectors = found.column("embedding").combine_chunks()
            yield found.column("query_id").combine_chunks(), _matrix(vectors, dims)


def _empty(base: DataFrame, queries: DataFrame) -> DataFrame:
    payload = [c for c in base.columns if c not in ("embedding", "cell")]
    none = F.lit(None)
    return base.limit(0).select(
        none.cast(queries.schema["query_id"].dataType).alias("query_id"),
        none.cast("double").alias("distance"),
        *payload,
    )


def _top(scans: list[DataFrame], k: int, id_col: str) -> DataFrame:
    rows = reduce(DataFrame.unionByName, scans)
    order = W.partitionBy("query_id").orderBy("distance", id_col)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(
    base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id"
) -> DataFrame:
    """Exact k nearest rows of ``base`` per query: ``query_id, distance, rank`` and the base's columns.

    ``base`` has ``embedding`` and ``id_col``, ``queries`` has ``query_id`` and ``embedding``.
    Metrics: ``l2``, ``cosine`` (1 - cosine) and ``dot`` (negative inner product). Hits of
    several queries are concatenated, not deduplicated. The queries are a request: they are
    read when the plan is made and shipped to the tasks in blocks of checked size.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    kind = queries.schema["query_id"].dataType
    scans = [
        _scan(base, ids, vectors, kind, k, metric, id_col, None) for ids, vectors in _blocks(queries)
    ]
    return _top(scans or [_empty(base, queries)], k, id_col)


def train_cells(base: DataFrame, cells: int, seed: int = 7, iterations: int = 10, fraction: float = 1.0) -> np.ndarray:
    """Centroids of a coarse quantizer by k-means. ``fraction`` is the share of rows trained on;
    every row is assigned to a cell whatever it is. Runs the jobs of the training."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = base if fraction >= 1.0 else base.sample(fraction, seed)
    rows = rows.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    fitted = KMeans(k=cells, seed=seed, maxIter=iterations, featuresCol="features").fit(rows)
    return np.array(fitted.clusterCenters())


def seed_cells(base: DataFrame, cells: int, id_col: str = "id") -> np.ndarray:
    """Centroids without training: the vectors of the ``cells`` smallest ids."""
    head = base.orderBy(id_col).select("embedding").limit(cells).toArrow().column("embedding").combine_chunks()
    return _matrix(head, len(head[0]))


def stored_cells(centers: DataFrame) -> np.ndarray:
    """Centroids given as the ``embedding`` of a few rows, in their order."""
    found = centers.select("embedding").toArrow().column("embedding").combine_chunks()
    return _matrix(found, len(found[0]))


def save_cells(spark: SparkSession, centroids: np.ndarray, path: str) -> None:
    """Write centroids next to the table whose cells they make."""
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_cells(spark: SparkSession, path: str) -> np.ndarray:
    stored = spark.read.parquet(path).orderBy("cell").toArrow().column("centroid").combine_chunks()
    return _matrix(stored, len(stored[0]))


def assign_cells(base: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add ``cell``: the nearest centroid. Write the result with ``partitionBy("cell")`` to let
    searches prune the cells that no query probes."""
    dims = centroids.shape[1]

    @F.arrow_udf(T.IntegerType())
    def nearest_cell(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            dist = _all_pairs(_matrix(batch, dims), centroids, "l2")
            yield pa.array(np.round(dist, 9).argmin(axis=1).astype(np.int32))

    return base.withColumn("cell", nearest_cell("embedding"))


def nearest_in_cells(
    base: DataFrame,
    queries: DataFrame,
    centroids: np.ndarray,
    k: int,
    probes: int,
    metric: str = "l2",
    id_col: str = "id",
) -> DataFrame:
    """Approximate k nearest rows: each query looks into its ``probes`` nearest cells.

    Within those cells the distances are exact, and probing all cells equals ``nearest``. A
    crowded cell is no bottleneck: cells select rows of a scan, they are not groups.
    """
    kind = queries.schema["query_id"].dataType
    scans = []
    for ids, vectors in _blocks(queries):
        dist = np.round(_all_pairs(vectors, centroids, "l2"), 9)
        near = np.argsort(dist, axis=1, kind="stable")[:, :probes]
        mask = np.zeros(dist.shape, bool)
        np.put_along_axis(mask, near, True, axis=1)
        scans.append(_probe(base, ids, vectors, kind, k, metric, id_col, mask))
    return _top(scans or [_empty(base, queries)], k, id_col)


def _probe(base, ids, vectors, kind, k, metric, id_col, mask: np.ndarray) -> DataFrame:
    wanted = [int(c) for c in np.flatnonzero(mask.any(axis=0))]
    return _scan(base.filter(F.col("cell").isin(wanted)), ids, vectors, kind, k, metric, id_col, mask)


def cell_radii(cells: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The largest distance of a row from its centroid, per cell; minus infinity for an empty cell. Runs a job."""
    dims = centroids.shape[1]

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii = np.full(len(centroids), -np.inf)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            np.maximum.at(radii, cell, _pairwise(_matrix(batch.column("embedding"), dims), centroids[cell], "l2"))
        held = np.flatnonzero(radii >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(radii[held])], ["cell", "radius"])

    radii = np.full(len(centroids), -np.inf)
    found = cells.select("cell", "embedding").mapInArrow(largest, "cell int, radius double")
    for row in found.groupBy("cell").agg(F.max("radius").alias("radius")).collect():
        radii[row.cell] = row.radius
    return radii


def nearest_by_bound(
    base: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int, probes: int = 1, id_col: str = "id"
) -> DataFrame:
    """The k nearest rows by l2 with cells passed over only if nothing in them can be a hit: equals ``nearest``.

    The ``probes`` nearest cells give each query a distance that its k-th hit does not exceed; by the
    triangle inequality a cell whose centroid is further away than that and the cell's radius holds none.
    Runs the jobs of the radii and of that first search.
    """
    radii = cell_radii(base, centroids)
    first = nearest_in_cells(base, queries, centroids, k, probes, "l2", id_col).groupBy("query_id")
    within = {r.query_id: r.far for r in first.agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect() if r.n >= k}
    kind, scans = queries.schema["query_id"].dataType, []
    for ids, vectors in _blocks(queries):
        bound = np.array([within.get(i, np.inf) for i in ids.to_pylist()])
        scale = np.sqrt((vectors**2).sum(1).max()) + np.sqrt((centroids**2).sum(1).max())
        mask = _all_pairs(vectors, centroids, "l2") <= bound[:, None] + radii[None, :] + 1e-6 * scale
        mask &= np.isfinite(radii)
        scans.append(_probe(base, ids, vectors, kind, k, "l2", id_col, mask))
    return _top(scans or [_empty(base, queries)], k, id_col)
