"""Targets, schedule and words taken against a plain walk along the streams."""

import math

import pytest
from pyspark.sql import functions as F

from chunkloom.llm.mixture import GOLDEN, MixParams, mixed, mixture, n_words, schedule, settled


def shares(sizes, weights, mix, repeats=3):
    """Targets by handing the excess out again until none is above its limit."""
    target, open_, left = {}, dict(enumerate(sizes)), mix
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] >= repeats * sizes[k]]
        if not full:
            target |= {k: unit * weights[k] for k in open_}
            break
        for k in full:
            target[k] = repeats * sizes[k]
            left -= target[k]
            del open_[k]
    return target


@pytest.mark.parametrize("sizes", [[100, 2000, 900, 40, 40, 3000], [10], [5, 5, 5, 5], [1, 100_000, 3]])
def test_targets(spark, sizes):
    rows = [(k, " ".join(["w"] * n), f"s{k}") for k, n in enumerate(sizes)]
    got = {r.source: r for r in mixture(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()}
    want = shares(sizes, [(5, 2, 1)[k % 3] for k in range(len(sizes))], sum(sizes))
    for k, n in enumerate(sizes):
        assert got[f"s{k}"].target == pytest.approx(want[k])
        assert got[f"s{k}"].source_size == n
        assert abs(got[f"s{k}"].taken - min(want[k], 3 * n)) <= 0.5001


def test_words_taken(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    counted = mixture(frame, keep=["doc_id", "source", "text"])
    rows = counted.collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(mixture(frame.repartition(7), keep=["doc_id", "source", "text"]).collect(), key=lambda r: r.doc_id)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        of = by.setdefault(r.source, [r.target, 0, r.source_size, 0, set()])
        of[1] += r.taken
        of[3] += r["size"]
        of[4].add(math.ceil(r.taken / r["size"]))
    for target, taken, size, total, copies in by.values():
        assert size == total
        assert abs(taken - target) <= 0.5001
        assert max(copies) - min(copies) <= 1  # one walk along the stream
    mix = mixed(counted).select("doc_id", n_words("text").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    assert {r.doc_id: r.n for r in mix} == {r.doc_id: r.taken for r in rows if r.taken}


def walk(rows, weights=(5, 2, 1), share=1.0, repeats=3):
    """``taken`` by row number: each source's stream, in the order of (key, row), walked word by word up to its target."""
    names = sorted({r.source for r in rows if r.source is not None}) + [None] * any(r.source is None for r in rows)
    sizes = [sum(r["size"] for r in rows if r.source == name) for name in names]
    target = shares(sizes, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes), repeats)
    taken = {}
    for k, name in enumerate(names):
        stream = sorted((r.key, n) for n, r in enumerate(rows) if r.source == name)
        left = int(target[k] + 0.5)
        while left:
            for _, n in stream:
                step = min(left, rows[n]["size"])
                taken[n] = taken.get(n, 0) + step
                left -= step
    return [taken.get(n, 0) for n in range(len(rows))]


@pytest.mark.parametrize("block", [1, 7, 128, 100_000])
def test_walk_along_the_streams(spark, block):
    """Sources of a few words beside large ones, at any size of blocks."""
    rows = [(k, "w " * (1 + k * 7919 % 400), f"big{k % 3}") for k in range(300)]
    rows += [(1000 + k, "x y z", f"small{k % 4}") for k in range(13)] + [(2000, "a b", None), (2001, None, "big0"), (2002, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.xxhash64("doc_id", "text"))
    got = mixture(frame, MixParams(block=block)).collect()
    assert [r.taken for r in got] == walk(got)


def test_walk_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("key", F.xxhash64("doc_id", "text"))
    got = mixture(frame, keep=["doc_id", "source", "key"]).collect()
    assert [r.taken for r in got] == walk(got)


def test_schedule(spark):
    """Golden-ratio points laid on the shares, slot by slot; what is short or left over stays small."""
    target = [50.0, 1.5e6, 7e5, 2.4, 9e4]
    sources = spark.createDataFrame(list(enumerate(target)), "rank int, target double")
    n, want, rank_of = 20_000, [0] * len(target), []
    for i in range(n):
        x, k = i * GOLDEN % 2**32 / 2**32, 0
        while k < len(target) - 1 and x >= sum(target[: k + 1]) / sum(target):
            k += 1
        want[k] += 1
        rank_of.append(k)
    got = schedule(sources, n)
    by = {k: sorted(r.block for r in got.where(F.col("rank") == k).collect()) for k in range(len(target))}
    assert by == {k: list(range(m)) for k, m in enumerate(want)}
    assert all(abs(m - n * t / sum(target)) < 10 for m, t in zip(want, target, strict=True))
    for block in (100, 114, 128):
        found = settled(got, sources, block).collect()
        for k, t in enumerate(target):
            own = sorted((r.block, r.words) for r in found if r["rank"] == k)
            assert [b for b, _ in own] == list(range(len(own))) and sum(w for _, w in own) == int(t + 0.5)
            assert all(w == block for _, w in own[:-1])


def test_plan_has_no_python(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixture(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, rank int, size int"
    assert mixture(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, None, 1, 1), (2, " \n", None, 1, 1)]
    assert {(r.taken, r.target) for r in mixture(spark.createDataFrame(rows, schema)).collect()} == {(0, 0.0)}
    rows = [(1, "a b c", None, 1, 1), (1, "a b c", None, 1, 1), (2, "d e", "x", 1, 1), (None, "q", "null", 1, 1), (5, "a", "", 1, 1), (6, None, "", 7, 1)]
    got = mixture(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6 and got[0]["rank"] in (1, 7)
    total = {}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r.taken
    want = {"": 3.0, "null": 7 * 2 / 8, "x": 7 / 8, None: 7 * 5 / 8}
    assert {r.source: r.target for r in got} == pytest.approx(want)
    assert all(abs(total[k] - want[k]) <= 2 for k in want)
    long = [(1, "w " * 300_000, "a"), (2, "w", "b")]
    assert [r.taken for r in mixture(spark.createDataFrame(long, "doc_id int, text string, source string")).orderBy("doc_id").collect()][0] > 290_000


def test_small_blocks_and_shares(spark):
    rows = [(k, "w " * (k % 50 + 1), "abc"[k % 3]) for k in range(200)]
    p = MixParams(weights=(1, 1, 4), share=0.5, block=10)
    got = mixture(spark.createDataFrame(rows, "doc_id int, text string, source string"), p).collect()
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(0.5 * sum(r["size"] for r in got))
    assert abs(sum(r.taken for r in got) - 0.5 * sum(r["size"] for r in got)) < 20
