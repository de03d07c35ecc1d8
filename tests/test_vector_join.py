"""Tiles against tiles: exact hits, and how little is measured for them."""

import numpy as np
import pytest

from chunkloom.operators import vector_join as vj
from chunkloom.operators import vectors
from chunkloom.operators.vector_join import TileParams, build_index, nearest_in_index, nearest_join, passing, train_quantizer

SMALL = [TileParams(rows=40, asks=7, cells=5, sample=200), TileParams(rows=40, asks=7, cells=5, sample=200, codes=False), TileParams(cells=1, probes=1, width=3)]


vj.PER_CELL = 20  # several cells for small tables


def frame(spark, data, ids=None):
    ids = range(len(data)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v], "text") for i, v in zip(ids, data, strict=True)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, cell string").repartition(4)


def key(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.distance, 7)) for r in df.collect())


def asked(base):
    return base.select(base.id.alias("query_id"), "embedding")


@pytest.mark.parametrize("p", SMALL)
def test_equal_to_the_scan(spark, p):
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(6, 10)) * 3
    data = (middles[draw.integers(0, 6, 500)] + draw.normal(size=(500, 10))).astype(np.float32)
    data[100:280] = data[100]  # a third are copies: ties go by id
    data[7] = 0
    base = frame(spark, data)
    queries = asked(base.where("id % 4 = 0"))
    for k in (1, 9, 200):
        assert key(nearest_join(base, queries, k, p)) == key(vectors.nearest(base.drop("cell"), queries, k))


@pytest.mark.parametrize("p", SMALL)
def test_odd_tables(spark, p):
    base = frame(spark, np.eye(3, 8)[[0, 1, 1]], [5, 6, 6])  # a repeated id stays several rows
    none = base.where("false")
    assert [r[:3] for r in key(nearest_join(base, asked(base.where("id = 5")), 10, p))] == [(5, 1, 5), (5, 2, 6), (5, 3, 6)]
    assert nearest_join(none, asked(base), 3, p).collect() == []
    assert nearest_join(base, asked(none), 3, p).collect() == []
    # far away questions and cells without a bound
    far = frame(spark, np.eye(3, 8) * 1e6, [1, 2, 3])
    assert len(key(nearest_join(base, asked(far), 2, p))) == 6


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_under_half_of_the_given_vectors_are_measured(spark, sf):
    """Recall 1 by brute force over the table, and the share of (question, vector) pairs that codes let through."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    rows = table.orderBy("id").collect()
    ids, data = np.array([r.id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    questions = np.flatnonzero(ids % 20 == 0)
    found = np.sqrt(((data[None, :, :] - data[questions][:, None, :]) ** 2).sum(2))
    want = {(int(ids[q]), int(ids[k])) for at, q in enumerate(questions) for k in np.lexsort((ids, found[at].round(9)))[:10]}
    queries = asked(table.where("id % 20 = 0"))
    index = build_index(table)
    got = {(r.query_id, r.id) for r in nearest_in_index(index, queries, 10).collect()}
    assert got == want
    # the second round's pairs, with the bounds of the first
    first = vj._blocks_of(vj._celled(queries, "query_id", index.quantizer, 1024)[0].selectExpr("*", "double('inf') AS bound"), 64)
    two = sorted(index.parts)[:2]
    probes = lambda own, a, b: two
    bounds = {}
    for r in vj._best(vj._met(vj._dealt(first, index, probes), index, 10, True), 10).collect():
        bounds[r.query_id] = max(bounds.get(r.query_id, 0), r.distance)
    bound = np.array([bounds[i] for i in ids[questions]])
    measured = 0
    for tile in index.tiles.collect():
        n = len(tile["ids"]) // 8
        codes = np.frombuffer(tile["codes"], np.uint8).reshape(n, -1)
        rows, _ = passing(data[questions], bound, np.frombuffer(tile["vectors"]).reshape(n, -1), index.quantizer, tile["cell"], codes, np.frombuffer(tile["left"]), 10, 2)
        measured += len(rows)
    assert measured < 0.5 * len(ids) * len(questions)


def test_codes_bound_the_distance(spark):
    draw = np.random.default_rng(9)
    data = draw.normal(size=(300, 7))
    q = train_quantizer(frame(spark, data), TileParams(cells=3))
    cell = vectors._all_pairs(data, q.centroids, "l2").argmin(axis=1)
    codes, left = q.encode(vj._padded(data - q.centroids[cell], 2))
    for c in range(3):
        own = cell == c
        coded = q.looked_up(vj._padded(data[:20] - q.centroids[c], 2), codes[own])
        true = vectors._all_pairs(data[:20], data[own], "l2")
        assert (np.abs(coded - true) <= left[own][None, :] + 1e-6).all()


def test_nothing_passes_through_the_driver(spark, monkeypatch):
    base = frame(spark, np.random.default_rng(1).normal(size=(50, 4)))
    index = build_index(base, TileParams(cells=4))
    monkeypatch.setattr(type(base), "toArrow", lambda self: pytest.fail("rows came to the driver"))
    assert nearest_in_index(index, asked(base), 3).count() == 150


def test_dealt_blocks_are_not_broadcast(spark):
    """They hold every question once per tile, whatever Spark takes them for; a broadcast would bring them to the driver."""
    base = frame(spark, np.random.default_rng(1).normal(size=(50, 4)))
    for p in (TileParams(cells=4), TileParams(cells=4, codes=False)):
        index = build_index(base, p)
        celled = vj._celled(asked(base), "query_id", index.quantizer, p.asks)[0].selectExpr("*", "double('inf') AS bound")
        cells = sorted(index.parts)
        dealt = vj._dealt(vj._blocks_of(celled, 4), index, lambda own, a, b, cells=cells: cells)
        plan = vj._met(dealt, index, 3, False)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
