"""Near-duplicate groups against all pairs of shingle sets."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from chunkloom.llm.circulant import NearParams, forest, near_duplicates, permute, signatures
from chunkloom.llm.components import components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def by_hand(docs, p):
    sets = defaultdict(list)
    for i, text in docs:
        sets[i].append(shingles(text, p.words))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i in sorted(sets):
        for own in sets[i]:
            common = Counter((j, k) for g in own for j, k in holders[g])
            for (j, k), n in common.items():
                if 100 * n >= p.percent * (len(own) + len(sets[j][k]) - n):
                    a, b = sorted((top(i), top(j)))
                    parent[b] = a
        for k, own in enumerate(sets[i]):
            for g in own:
                holders[g].append((i, k))
    return {i: top(i) for i in sets}


def check(spark, docs, p):
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), p).collect()
    assert len(rows) == len(docs)
    want = by_hand(docs, p)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    sizes = {(i, len(shingles(t, p.words))) for i, t in docs}
    assert {(r.doc_id, r.n_shingles) for r in rows} == sizes


@pytest.mark.parametrize("p", [NearParams(), NearParams(words=5, percent=80)])
def test_mutated_copies(spark, p):
    draw = random.Random(p.words)
    words = [f"w{k}" for k in range(300)]
    docs = []
    for base in range(6):
        text = [draw.choice(words) for _ in range(draw.choice([3, 30, 120]))]
        for _ in range(25):
            copy = list(text)
            for _ in range(draw.randrange(6)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            docs.append((len(docs) * 3 % 1000, " ".join(copy)))
    docs += [(2000, None), (2001, ""), (2002, "Word"), (2003, "wORD"), (2004, " \n"), (2005, "É a b"), (2006, "é a b")]
    check(spark, docs, p)


def test_chain_whose_ends_differ(spark):
    """Each text is near the next only; the least id lies in the middle."""
    words = [f"v{k}" for k in range(200)]
    docs = [((k * 7 + 3) % 19, " ".join(words[k * 5 : k * 5 + 100])) for k in range(19)]
    check(spark, docs, NearParams(words=1, percent=90))


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, docs, NearParams())


def test_nulls_repeated_ids_and_no_rows(spark):
    frame = spark.createDataFrame(
        [(None, "a b c d", 1), (7, "a b c d", 2), (7, "a b c d", 3), (7, "x y z q", 4), (9, "x y z q", 5)],
        "doc_id long, text string, band int",
    )
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame).collect()), key=repr)
    assert got == [(7, 7, True)] * 3 + [(9, 7, False), (None, None, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_agree_like_the_sets():
    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 64, 1500, dtype=np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:1200])  # 800 of 1,200
    found = signatures(np.concatenate([a, b]), np.array([0, 1000, 2000, 2000]), 600)
    assert abs((found[0] == found[1]).mean() - 800 / 1200) < 0.08
    assert not found[2].any()
    assert len(np.unique(permute(np.arange(1 << 16, dtype=np.uint32)))) == 1 << 16


def test_forest_connects_what_the_matrix_connects():
    near = np.array([[1, 0, 0], [1, 1, 0], [0, 0, 0]], bool)
    a, root = forest(near, np.array([5, 3, 9]), np.array([8, 4, 1]))
    assert {(int(x), int(y)) for x, y in zip(a, root)} == {(5, 3), (3, 3), (8, 3), (4, 3)}


def test_components_of_long_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
