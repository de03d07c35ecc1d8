"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from chunkloom.llm.variants import Acceptor, document_words, near_words, spelling_forms, spelling_variants, vocabulary


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def by_hand(counts, ratio=10):
    deleted = {}
    for w in counts:
        for k in range(len(w) + 1):
            for key in ({w[:k] + w[k + 1 :], w}):
                deleted.setdefault(key, set()).add(w)
    out = {}
    for w, n in counts.items():
        others = set()
        for k in range(len(w) + 1):
            for key in (w[:k] + w[k + 1 :], w):
                others |= {v for v in deleted[key] if near(v, w)}
        form = min(others, key=lambda v: (-counts[v], v), default=None)
        out[w] = (form if form is not None and counts[form] >= ratio * n else None, n, len(others))
    found = {}
    for w, (form, n, many) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        found[w] = (form, root, n, many, counts[form] if form else None)
    return found


def words_by_hand(docs, least=7, every=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= least
    return {w: n for w, n in counts.items() if n >= 2}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.fixture(scope="module")
def counts():
    draw = random.Random(3)
    base = ["".join(draw.choice("abé") for _ in range(draw.randint(0, 9))) for _ in range(500)]
    base += ["aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "bababab", "aaaaaaa", "", "a", "b", "x" * 300, "x" * 299, "x" * 150 + "y" + "x" * 150]
    return {w: draw.choice([1, 2, 3, 30, 40, 500, 10_000]) for w in base}


def test_acceptor_is_minimal_and_pairs_come_once(counts):
    machine = Acceptor(sorted(counts))
    states = {(machine.final[q], tuple(machine.arcs[q].items())) for q in range(len(machine.arcs))}
    assert len(states) == len(machine.arcs)
    pairs = [frozenset(x) for x in machine.pairs()]
    assert len(pairs) == len(set(pairs))
    words = sorted(counts)
    assert set(pairs) == {frozenset((a, b)) for k, a in enumerate(words) for b in words[k + 1 :] if near(a, b)}


@pytest.mark.parametrize("leaf", [1, 7, 60, 10_000])
def test_split_prefixes_lose_and_repeat_nothing(spark, counts, leaf):
    short = {w: n for w, n in counts.items() if len(w) < 20 or leaf > 1}
    rows = spark.createDataFrame(list(short.items()), "word string, n long")
    pairs = Counter((r.word, r.near, r.n, r.near_n) for r in near_words(rows, leaf).collect())
    words = sorted(short)
    assert pairs == Counter((a, b, short[a], short[b]) for a in words for b in words if near(a, b))
    assert found(spelling_forms(rows, leaf=leaf)) == by_hand(short)


def test_whole_table_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = words_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    got = found(spelling_variants(docs))
    assert got == by_hand(want)
    assert sum(v[0] is not None for v in got.values()) >= 5


def test_odd_rows(spark):
    rows = [
        (1, None, "x"), (None, "Thousand thousand THOUSAND thousänd×÷", "y"), (2, "", "y"), (3, "thousand " * 3000, "z"), (3, "thousand " * 3000, "z"),
        (4, "y" * 100_000 + " " + "y" * 100_000 + " short", None), (5, "Élèvement élèvement 中文字中文字中文字", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(2)
    assert found(spelling_variants(docs)) == by_hand(words_by_hand([r[:2] for r in rows]))
    assert found(spelling_variants(docs.where("false"))) == {}
    assert vocabulary(document_words(docs)).columns == ["word", "n"]


def test_roots_follow_long_chains(spark):
    counts = {"a" * k: 20**k for k in range(1, 12)}
    got = found(spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == by_hand(counts)
    assert {v[1] for v in got.values()} == {"a" * 11}
