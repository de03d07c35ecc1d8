"""Backoff scores against counting in dictionaries."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from chunkloom.llm import backoff
from chunkloom.llm.backoff import BackoffParams, backoff_scores, delta, full, slim, undelta


def by_hand(docs, p):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in docs]
    count = Counter(tuple(w[k : k + n]) for w in texts for n in range(1, p.order + 1) for k in range(len(w) - n + 1))
    total = sum(map(len, texts)) or 1
    log = lambda x: round(1e6 * math.log(x))
    out = []
    for (i, _), words in zip(docs, texts):
        score, levels = 0, [0] * p.order
        for at in range(len(words)):
            best = min(at + 1, p.order)
            level = next((n for n in range(best, 1, -1) if count[tuple(words[at - n + 1 : at + 1])] >= p.least), 1)
            gram = tuple(words[at - level + 1 : at + 1])
            score += log(count[gram]) - log(count[gram[:-1]] if level > 1 else total) + (best - level) * log(p.penalty)
            levels[level - 1] += 1
        out.append((i, len(words), *levels, score))
    return out


DOCS = [
    (1, None), (2, ""), (3, "a"), (4, "A b a B a b"), (5, "a b c d e"), (6, "x y z"), (7, "a b c x y z " * 50), (8, "a b c"), (8, "a b c"),
    (9, " ".join(f"w{k}" for k in range(3000))), (10, "é É ü b"),
]


@pytest.mark.parametrize("p", [BackoffParams(), BackoffParams(order=1), BackoffParams(order=4, least=3, penalty=0.5)])
@pytest.mark.parametrize("share", [5 << 20, 700])
def test_scores(spark, monkeypatch, p, share):
    monkeypatch.setattr(backoff, "SHARE", share)
    frame = spark.createDataFrame(DOCS, "doc_id int, text string").repartition(3)
    got = backoff_scores(frame, p, keep=["doc_id"]).collect()
    columns = ["doc_id", "n_words", *(f"level_{k}" for k in range(1, p.order + 1)), "score_micro"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(by_hand(DOCS, p))
    for r in got:
        assert r.score == (r.score_micro / 1e6 / r.n_words if r.n_words else None)


def test_no_rows_and_clashing_columns(spark):
    assert backoff_scores(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    frame = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id int, text string, part int, n_words int")
    assert backoff_scores(frame).select("part", "n_words").first() == (3, 2)


def test_slim_counts():
    counts = np.array([1, 254, 255, 256, 10**12, 3])
    assert full(*slim(counts)).tolist() == counts.tolist()


def test_words_whose_hashes_differ_in_the_high_bits_only(spark):
    """The hashes of each pair have equal low 40 bits."""
    docs = [(1, "w260662 w508423"), (2, "w183425 a w3641368 w260662"), (3, "w102424 w2994667 w102424 a")]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    p = BackoffParams()
    got = [(r.doc_id, r.n_words, r.level_1, r.level_2, r.level_3, r.score_micro) for r in backoff_scores(frame, p).collect()]
    assert sorted(got) == by_hand(docs, p)


def test_steps_of_hashes():
    rng = np.random.default_rng(1)
    for keys in (
        np.array([0, 1, 1 << 32, 1 << 40, (1 << 48) + 5, (1 << 63) + 9, (1 << 64) - 1], dtype=np.uint64),
        np.array([(1 << 64) - 1], dtype=np.uint64),
        np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64)),
        np.unique(rng.integers(0, 1 << 50, 5000, dtype=np.uint64)),
    ):
        assert (undelta(*delta(keys)) == keys).all()
