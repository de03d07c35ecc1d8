"""Near-duplicate vectors by product quantisation, with an exact cosine at the end.

Unit vectors fall into inverted lists around coarse centres; a vector's residual is coded by one
codeword per subspace. A query looks up its squared distance to every vector of a list in one
table per subspace. Nothing within the threshold is lost by either step:

* A vector within distance ``r`` of the query lies in a list whose boundary towards the query's own
  list is not farther than ``r``: those lists are the probes.
* A looked-up distance is wrong by at most the vector's own coding error, which is stored, so
  whatever is within ``r`` plus that error is measured exactly.

Equal vectors are one class that counts its members. Lists are dealt into tiles; two tiles give
counts and a spanning forest of their links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.circulant import forest
from chunkloom.llm.components import components
from chunkloom.session import materialize

SLACK = 1e-9


@dataclass(frozen=True)
class QuantParams:
    """``sample`` vectors at most train the centres and codebooks; all vectors are indexed.

    ``per_list`` vectors are aimed at per list, as far as the sample can train centres; longer lists are
    searched whole.
    """

    cosine: float = 0.98
    sample: int = 20_000
    per_list: int = 400
    subspaces: int = 8
    words: int = 64
    tile: int = 512
    rounds: int = 12

    @property
    def reach(self) -> float:
        """The distance of unit vectors at the threshold."""
        return float(np.sqrt(max(0.0, 2 - 2 * self.cosine)))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances between rows."""
    return np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)


def k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres of rows, started from rows spread evenly over the given order; deterministic."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = squares(x, centres).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


@dataclass
class Quantiser:
    centres: np.ndarray
    books: list[np.ndarray]

    @classmethod
    def trained(cls, x: np.ndarray, lists: int, p: QuantParams) -> Quantiser:
        centres = k_means(x, lists, p.rounds)
        rest = x - centres[squares(x, centres).argmin(axis=1)]
        return cls(centres, [k_means(part, p.words, p.rounds) for part in np.array_split(rest, min(p.subspaces, x.shape[1]), axis=1)])

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, codes and coding errors of vectors."""
        lists = squares(x, self.centres).argmin(axis=1)
        rest = x - self.centres[lists]
        parts = np.array_split(rest, len(self.books), axis=1)
        codes = np.stack([squares(part, book).argmin(axis=1) for part, book in zip(parts, self.books, strict=True)], axis=1)
        known = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return lists, codes.astype(np.uint8), np.sqrt(((rest - known) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, lists: np.ndarray, reach: float) -> np.ndarray:
        """Flags (vector, list) of the lists that may hold a vector within ``reach``."""
        to = squares(x, self.centres)
        own = to[np.arange(len(x)), lists]
        apart = np.sqrt(squares(self.centres, self.centres))[lists]
        return to - own[:, None] <= 2 * reach * apart + SLACK

    def looked_up(self, x: np.ndarray, centre: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of queries to the coded vectors of one list, by table."""
        rest = np.array_split(x - self.centres[centre], len(self.books), axis=1)
        total = np.zeros((len(x), len(codes)))
        for m, (part, book) in enumerate(zip(rest, self.books, strict=True)):
            total += squares(part, book)[:, codes[:, m]]
        return total


def units(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, dims, unit): unit vectors as doubles; ``unit`` is null where nothing can be linked."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            for value in batch.column(2):
                x = value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.zeros(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0
                dims.append(len(x))
                if top > 0:
                    x = x / top
                    out.append((x / np.sqrt((x**2).sum()) + 0.0).tobytes())
                else:
                    out.append(None)
            columns = [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "dims", "unit"])

    found = rows.mapInArrow(run, "vec_id long, label string, dims int, unit binary")
    return found.withColumn("unit", F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("unit")))


def _rows(column: pa.Array, kind: str = "<f8") -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1)


def _train(classes: DataFrame, p: QuantParams) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors, from a bounded sample of each."""
    out = {}
    for row in classes.groupBy("dims").agg(F.count("*").alias("n")).collect():
        chance = p.sample / row["n"]
        unit = F.xxhash64("vec_id") / F.lit(2.0**64) + F.lit(0.5)
        drawn = classes.where((F.col("dims") == row["dims"]) & (unit < chance)).select("vec_id", "unit").limit(2 * p.sample)
        drawn = sorted(drawn.toPandas().itertuples(index=False)) or [tuple(classes.where(F.col("dims") == row["dims"]).select("vec_id", "unit").first())]
        x = np.frombuffer(b"".join(r[1] for r in drawn), dtype="<f8").reshape(len(drawn), -1)
        out[row["dims"]] = Quantiser.trained(x, max(1, min(row["n"] // p.per_list, len(x) // 20)), p)
    return out


def embedding_duplicates(
    vectors: DataFrame, p: QuantParams = QuantParams(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links join vectors of one label with at least ``p.cosine``.

    A vector that is null, empty or zero or holds a null or a non-finite number, a null label and a
    null vec_id have no links. Only vectors of one length are compared. Equal vectors are linked; a
    row that repeats a vec_id counts as one more vector, whatever its vector and label, and belongs to one
    component with the others. An empty table gives no rows; other columns are ignored.
    """
    rows = materialize(units(vectors, vec_id, vector, label), "units")
    known = rows.where("unit is not null")
    key = ["label", "dims", "unit"]
    # A class has a number of its own: one vec_id may occur with several vectors or labels.
    classes = known.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members"))
    classes = materialize(classes.withColumn("class", F.xxhash64(*key)), "classes")
    shared = vectors.sparkSession.sparkContext.broadcast(_train(classes, p))
    reach = p.reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x, quantiser = _rows(part.column(1)), shared.value[int(d)]
                lists, codes, errors = quantiser.coded(x)
                probed = quantiser.probes(x, lists, reach)
                cuts = pa.array(np.append(0, np.cumsum(probed.sum(axis=1))), pa.int32())
                codes = pa.array([c.tobytes() for c in codes], pa.binary())
                probed = pa.ListArray.from_arrays(cuts, pa.array(np.nonzero(probed)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lists.astype(np.int32)), codes, pa.array(errors), probed],
                    names=[*part.schema.names, "list", "codes", "error", "probes"],
                )

    whole = classes.select("dims", "unit", "class", "members", "label")
    added = "dims int, unit binary, class long, members long, label string, list int, codes binary, error double, probes array<int>"
    coded = materialize(whole.mapInArrow(run, added), "coded")
    group = F.struct("label", "dims", F.col("list"))
    base = coded.withColumn("group", group)
    asked = coded.withColumn("list", F.explode("probes")).withColumn("group", group)
    pairs = _query_tiles(asked, base, p.tile)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, left, right in zip(*(batch.column(k) for k in range(3)), strict=True):
                q, b = left.values.flatten(), right.values.flatten()
                where = where.as_py()
                quantiser = shared.value[where["dims"]]
                x, y = _rows(q[1]), _rows(b[1])
                far = quantiser.looked_up(x, where["list"], _rows(b[2], "u1"))
                near = far <= (reach + b[3].to_numpy()[None, :]) ** 2 + SLACK
                a, c = q[0].to_numpy(), b[0].to_numpy()
                near &= a[:, None] != c[None, :]
                i, j = np.nonzero(near)
                close = np.einsum("ij,ij->i", x[i], y[j]) >= p.cosine
                near[i[~close], j[~close]] = False
                counts = near @ b[4].to_numpy()
                ids, roots = forest(near, a, c)
                some = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([a[some], ids]).astype(np.int64)),
                        pa.array(np.concatenate([a[some], roots]).astype(np.int64)),
                        pa.array(np.concatenate([counts[some], np.zeros(len(ids))]).astype(np.int64)),
                    ],
                    names=["a", "b", "n"],
                )

    found = materialize(pairs.mapInArrow(search, "a long, b long, n long"), "found")
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    first = classes.select("class", "vec_id")
    between = found.where("a <> b").join(first.toDF("a", "left"), "a").join(first.toDF("b", "right"), "b")
    same = known.join(classes.select(*key, F.col("vec_id").alias("first")), key).where("vec_id <> first")
    joined = components(between.select(F.col("left").alias("a"), F.col("right").alias("b")).unionAll(same.select("vec_id", "first")))
    linked = (
        known.join(classes.select(*key, "class", "members"), key)
        .join(counts, "class", "left")
        .select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    )
    every = linked.unionAll(rows.where("unit is null").select("vec_id", F.lit(0).cast("long")))
    component = F.coalesce("component_id", "vec_id")
    return every.join(joined.withColumnRenamed("id", "vec_id"), "vec_id", "left").select(
        "vec_id", "n_links", component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def _query_tiles(asked: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """(group, queries, vectors): pairs of a tile of queries and a tile of the list they probe."""

    def tiles(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
        count = rows.groupBy("group").agg(F.ceil(F.count("*") / size).alias("tiles"))
        tile = F.pmod(F.xxhash64("class"), F.col("tiles"))
        return rows.join(count, "group").groupBy("group", tile.alias(f"{name}_tile")).agg(F.collect_list(F.struct(*fields)).alias(name))

    left = tiles(asked, ["class", "unit"], "queries")
    right = tiles(base, ["class", "unit", "codes", "error", "members"], "vectors")
    return left.join(right, "group").select("group", "queries", "vectors")
