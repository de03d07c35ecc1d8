"""Removed passages against all 50-byte strings of the input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chunkloom.llm.repeats import intervals, suffix_array, without_repeats


def by_hand(docs, width=50):
    """{doc_id: (n_bytes, n_removed, n_spans, digest)} from the first owner of every string."""
    first = {}
    for i, text in sorted(docs):
        for k in range(len(text) - width + 1):
            first.setdefault(text[k : k + width], i)
    out = {}
    for i, text in docs:
        gone = np.zeros(len(text) + 1, int)
        for k in range(len(text) - width + 1):
            if first[text[k : k + width]] < i:
                gone[k] += 1
                gone[k + width] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int(gone[0] + (gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out[i] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(frame):
    rows = without_repeats(frame, keep=["doc_id"], kept="digest").collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_bytes.decode()) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_spliced_texts(spark, seed):
    draw = random.Random(seed)
    base = ["".join(draw.choice("ab c") for _ in range(200)) for _ in range(4)]
    docs = []
    for i in range(150):
        a, b = sorted(draw.sample(range(200), 2))
        text = draw.choice(base)[a:b] + draw.choice(["", "a", "bb", "é" * 30]) + draw.choice(base)[: draw.randrange(200)]
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(text) + 1)
            text = text[:k] + draw.choice("abxyz") + text[k:]
        docs.append((i, "ab" * draw.randrange(80) if i % 10 == 0 else text))
    docs += [(400, None), (401, ""), (402, "a" * 300), (403, "a" * 200), (404, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(frame) == by_hand([(i, (t or "").encode()) for i, t in docs])


def test_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text.encode()) for r in frame.collect()]
    assert found(frame) == by_hand(docs)


def test_long_text_and_chain_of_nested_repeats(spark):
    passage = "".join(random.Random(5).choice("abcdefgh ") for _ in range(400))
    docs = [(k, passage[: 60 + k]) for k in range(0, 300, 7)] + [(1000, "x".join([passage] * 500))]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == by_hand([(i, t.encode()) for i, t in docs])


def test_nulls_repeated_rows_and_clashing_columns(spark):
    text = "".join(random.Random(7).choice("abcdefgh ") for _ in range(120))
    rows = [(None, text, "a"), (5, text, "b"), (5, text, "c"), (6, None, "d"), (7, text[:60] + "é" * 40, "e")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, uid string").withColumn("n_removed", F.lit("x"))
    got = without_repeats(frame)
    assert "uid" in got.columns
    found = sorted(((r.doc_id, r.uid, r.n_removed) for r in got.collect()), key=repr)
    assert found == [(5, "b", 0), (5, "c", 0), (6, "d", 0), (7, "e", 60), (None, "a", 120)]


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_characters(spark):
    passage = "ab" * 30
    rows = [(1, passage + "ü"), (2, passage + "ü€")]
    left = {r.doc_id: r for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), kept="text").collect()}
    assert bytes(left[2].kept_bytes).decode() == "€"


def test_interval_tree_of_a_small_suffix_array():
    data = np.frombuffer(b"xabcdyabcdzabce", np.uint8)
    start = np.array([1, 6, 11])
    order, common = suffix_array(data, start, start + 4, np.zeros(3, np.int64), 2, 4)
    assert order.tolist() == [0, 1, 2] and common.tolist() == [0, 4, 3]
    tree, lengths = intervals(common, np.array([0, 1, 2]), np.array([120, 121, 122]))
    assert sorted(t[:3] for t in tree) == [(3, 0, 2), (4, 0, 1)]
    assert lengths.tolist() == [0, 4, 3]
    _, same_left = intervals(common, np.array([0, 1, 2]), np.array([120, 120, 120]))
    assert same_left.tolist() == [0, 0, 0]
