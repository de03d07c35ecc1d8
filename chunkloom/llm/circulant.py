"""Near-duplicate documents by circulant MinHash, with links confirmed on full shingle sets.

A shingle's 64-bit hash gives its place on a ring of 2^32 (the first permutation). Coordinate
``k`` of a signature is the least value that one second permutation, shifted by ``k`` around the
ring, takes on the set, so two permutations make all coordinates.

Documents with equal sets form one class. Signatures are cut into bands; in a bucket every class
is compared with the least one, first by the signatures' agreement, then on the full sets. Buckets that then
still hold classes of several components are compared whole, in tiles of bounded size: similar
signatures put classes into groups, and in a group all full sets of different components are
compared. Tiles give a spanning forest of what they find, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.components import components
from chunkloom.llm.text import (
    LOWER,
    blocks,
    mix,
    packed,
    prefix_hashes,
    sets,
    shingle_hashes,
    span_hashes,
    word_spans,
)
from chunkloom.session import materialize

TILE = 1024


@dataclass(frozen=True)
class NearParams:
    """Shingles of ``words`` words; a link needs ``100 * common >= percent * all``.

    A pair at the threshold misses all bands with probability ``(1 - t^rows)^bands``: 7e-8 for the
    defaults at 85 %. ``spread`` standard errors below the threshold, signatures rule a pair out.
    """

    words: int = 3
    percent: int = 85
    bands: int = 28
    rows: int = 5
    spread: float = 5.0

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows

    @property
    def least_equal(self) -> int:
        """Signature coordinates that must agree."""
        t = self.percent / 100
        return int(self.coordinates * (t - self.spread * (t * (1 - t) / self.coordinates) ** 0.5))


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, bounds) of the shingle sets of a text column, block by block."""
    for first, end, data, offsets in blocks(column):
        lowered = LOWER[data]
        starts, ends, bounds = word_spans(lowered, offsets)
        found = span_hashes(prefix_hashes(lowered), starts, ends)
        yield first, end, *sets(*shingle_hashes(found, bounds, words), end - first)


def permute(x: np.ndarray) -> np.ndarray:
    """The second permutation, a bijection of 32-bit integers."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(hashes: np.ndarray, bounds: np.ndarray, coordinates: int) -> np.ndarray:
    """One row of coordinates per set; an empty set has none and gets zeros."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, coordinates), dtype=np.uint32)
    if len(full):
        ring, cuts = (hashes >> np.uint64(32)).astype(np.uint32), bounds[full]
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat(permute(ring + np.uint32(k)), cuts)
    return out


SIGNED = "n_shingles long, set_a long, set_b long, bands array<long>, sketch binary"


def signed(docs: DataFrame, p: NearParams, text: str, doc_id: str) -> DataFrame:
    """(doc_id, n_shingles, two hashes of the set, band keys, one byte per coordinate)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, hashes, bounds in shingle_sets(batch.column(1), p.words):
                n, sizes = end - first, np.diff(bounds)
                sums = np.zeros((2, len(hashes) + 1), dtype=np.uint64)
                np.cumsum(mix(hashes), out=sums[0, 1:])
                np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=sums[1, 1:])
                whole = sums[:, bounds[1:]] - sums[:, bounds[:-1]]
                coordinates = signatures(hashes, bounds, p.coordinates)
                keys = np.empty((n, p.bands), dtype=np.uint64)
                for band in range(p.bands):
                    key = np.full(n, band, dtype=np.uint64)
                    for k in range(band * p.rows, (band + 1) * p.rows):
                        key = mix(key * np.uint64(0x9FB21C651E98DF25) + coordinates[:, k])
                    keys[:, band] = key
                some = sizes > 0
                cuts = pa.array(np.append(0, np.cumsum(some * p.bands)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(whole[0].view(np.int64)),
                        pa.array(whole[1].view(np.int64)),
                        pa.ListArray.from_arrays(cuts, pa.array(keys[some].ravel().view(np.int64))),
                        packed(coordinates.astype(np.uint8).ravel(), np.arange(n + 1) * p.coordinates),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SIGNED}")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def alike(pairs: DataFrame, classes: DataFrame, p: NearParams) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough for the threshold."""
    sketch = classes.select("doc_id", "sketch")
    both = pairs.join(sketch.withColumnsRenamed({"doc_id": "a", "sketch": "left"}), "a").join(
        sketch.withColumnsRenamed({"doc_id": "b", "sketch": "right"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column(2), p.coordinates), _matrix(batch.column(3), p.coordinates)
            near = pa.array((left == right).sum(axis=1) >= p.least_equal)
            yield batch.select([0, 1]).filter(near)

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, p: NearParams, text: str, doc_id: str) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    both = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "left"}), "a").join(
        texts.withColumnsRenamed({"id": "b", "text": "right"}), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sides = [list(shingle_sets(part.column(k), p.words)) for k in (2, 3)]
                hashes = np.concatenate([x[2] for side in sides for x in side])
                owner = np.concatenate(
                    [np.repeat(np.arange(x[0], x[1]), np.diff(x[3])) for side in sides for x in side]
                )
                total = np.bincount(owner, minlength=part.num_rows)
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                twice = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
                common = np.bincount(owner[1:][twice], minlength=part.num_rows)
                yield part.select([0, 1]).filter(pa.array((common > 0) & (100 * common >= p.percent * (total - common))))

    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def _tile_pairs(rows: DataFrame, group: str, size: int, fields: list[str]) -> DataFrame:
    """Pairs (left, right) of tiles of one group, each a list of structs of ``fields``.

    A group is dealt by hash into tiles of about ``size`` rows; its pairs are dealt over the tasks, so that a
    large group's pairs do not meet in one.
    """
    tiles = rows.groupBy(group).agg(F.ceil(F.count("*") / size).alias("tiles"))
    tiles = (
        rows.join(tiles, group)
        .groupBy(group, F.pmod(F.xxhash64("doc_id"), F.col("tiles")).alias("tile"))
        .agg(F.collect_list(F.struct(*fields)).alias("rows"))
    )
    right = tiles.select(group, F.col("tile").alias("other"), F.col("rows").alias("right"))
    pairs = tiles.withColumnRenamed("rows", "left").join(right, group).where("tile <= other")
    return pairs.repartition(group, "tile", "other").select("left", "right")


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the matrix ``near`` of rows ``a`` and columns ``b`` connects, at most one per id."""
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near, a, b = near[np.ix_(rows, columns)], a[rows], b[columns]
    if not len(a):
        return a, b
    top = np.iinfo(np.int64).max
    left, right = a.copy(), np.full(len(b), top)
    while True:
        right_new = np.minimum(right, np.where(near, left[:, None], top).min(axis=0))
        left_new = np.minimum(left, np.where(near, right_new[None, :], top).min(axis=1))
        if np.array_equal(left_new, left) and np.array_equal(right_new, right):
            return np.concatenate([a, b]), np.concatenate([left, right])
        left, right = left_new, right_new


def _forests(pairs: DataFrame, near) -> DataFrame:
    """Links of the matrices that ``near`` makes of two tiles (lists of Arrow columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                x, y = left.values.flatten(), right.values.flatten()
                a, b, part_a, part_b = (side[k].to_numpy() for k in (0, 1) for side in (x, y))
                found = near(x, y) & (part_a[:, None] != part_b[None, :])
                links = forest(found, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in links], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _similar(p: NearParams):
    """Matrix of signatures that agree often enough."""

    def near(x: list[pa.Array], y: list[pa.Array]) -> np.ndarray:
        left, right = _matrix(x[2], p.coordinates), _matrix(y[2], p.coordinates)
        return np.array([(right == row).sum(axis=1) >= p.least_equal for row in left]).reshape(len(left), len(right))

    return near


def _linked(p: NearParams):
    """Matrix of full shingle sets that reach the threshold, by products of their incidence matrices."""

    def incidence(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = list(shingle_sets(column, p.words))
        return np.concatenate([x[2] for x in found]), np.concatenate([np.repeat(np.arange(x[0], x[1]), np.diff(x[3])) for x in found])

    def near(x: list[pa.Array], y: list[pa.Array]) -> np.ndarray:
        (left, row), (right, column) = incidence(x[2]), incidence(y[2])
        shared = np.intersect1d(left, right)
        sizes = np.bincount(row, minlength=len(x[2]))[:, None] + np.bincount(column, minlength=len(y[2]))[None, :]
        common = np.zeros(sizes.shape)
        for at in range(0, len(shared), 4096):
            some = shared[at : at + 4096]
            sides = []
            for values, owner, n in ((left, row, len(x[2])), (right, column, len(y[2]))):
                place = np.minimum(np.searchsorted(some, values), len(some) - 1)
                use = some[place] == values
                side = np.zeros((n, len(some)), dtype=np.float32)
                side[owner[use], place[use]] = 1
                sides.append(side)
            common += sides[0] @ sides[1].T
        return (common > 0) & (100 * common >= p.percent * (sizes - common))

    return near


def near_duplicates(
    docs: DataFrame, p: NearParams = NearParams(), text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    A null text and one without words has no shingles and no links. Equal sets are linked. Rows
    that repeat a doc_id are one document: they share a component. A null doc_id is linked with
    nothing, has no component and is kept. Other columns of ``docs`` are not looked at. An empty
    table gives no rows. Very long texts are read whole.
    """
    rows = materialize(signed(docs, p, text, doc_id), "signed")
    known = rows.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = materialize(
        known.groupBy(*key).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    banded = classes.select("doc_id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1")
    first = banded.join(least, "band").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    tried = materialize(alike(first, classes, p), "pairs")
    links = materialize(confirmed(tried, docs, p, text, doc_id), "links")

    parts = components(links)
    owned = classes.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "bands", "sketch", F.coalesce("component_id", "doc_id").alias("part")
    )
    spread = owned.select("doc_id", "part", F.explode("bands").alias("band"))
    mixed = (
        spread.groupBy("band")
        .agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
        .where("low <> high and n > 2")
        .select("band")
    )
    rest = spread.join(mixed, "band").join(owned.select("doc_id", "sketch"), "doc_id")
    sketches = _tile_pairs(rest, "band", TILE, ["doc_id", "part", "sketch"])
    groups = components(_forests(sketches, _similar(p)))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    grouped = groups.join(owned.select(F.col("doc_id").alias("id"), "part"), "id").withColumnRenamed("id", "doc_id").join(texts, "doc_id")
    more = _forests(_tile_pairs(grouped, "component_id", TILE // 4, ["doc_id", "part", "text"]), _linked(p))

    same = known.join(classes.select(*key, F.col("doc_id").alias("b")), key).select(F.col("doc_id").alias("a"), "b").where("a <> b")
    found = components(links.unionAll(more).unionAll(same))
    return (
        rows.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.coalesce("component_id", "doc_id").alias("component_id"),
            (F.coalesce("component_id", "doc_id", F.lit(0)) == F.coalesce("doc_id", F.lit(0))).alias("kept"),
        )
    )
