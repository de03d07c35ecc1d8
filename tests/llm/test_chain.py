"""The classifier chain: held-out accuracy, fold discipline and odd rows."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chunkloom.llm import queries
from chunkloom.llm.chain import Chain, ChainParams, chain_scores, trained


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low"), "toxic")
    rows = docs.join(labels, "doc_id").withColumn("held", F.pmod(F.xxhash64("text", F.lit(9)), F.lit(4)) == 0)
    chain = trained(rows.where("not held"), rows, ["low", "toxic"])
    got = chain_scores(rows.where("held").select("doc_id", "text", "toxic"), chain).collect()
    truth, said = np.array([r.toxic == 1 for r in got]), np.array([r.p_toxic >= 0.5 for r in got])
    assert truth.sum() > 60
    assert said[~truth].mean() < 0.01
    assert said[truth].mean() > 0.8


def test_later_models_see_earlier_categories():
    """The second label follows the first one's words only through its probability."""
    draw = random.Random(1)
    texts, first, second = [], [], []
    for _ in range(600):
        a = draw.random() < 0.4
        texts.append(" ".join([draw.choice(["bad", "worse", "vile"])] * a + [draw.choice("abcdefghij") for _ in range(12)]))
        first.append(float(a))
        second.append(float(a))
    fold = np.arange(600) % 4
    chain = Chain.fitted(pa.array(texts), {"one": np.array(first), "two": np.array(second)}, fold, ChainParams(rounds=80))
    assert [len(m.earlier) for m in chain.models] == [0, 1]
    assert chain.models[1].earlier[0] > 0.1
    chances = chain.chances(chain.rows(*hashes(["vile a b", "a b c", ""])))
    assert chances[0].min() > 0.9 and chances[1].max() < 0.1


def hashes(texts):
    from chunkloom.llm.chain import distinct_words

    found = list(distinct_words(pa.array(texts)))
    return found[0][2], found[0][3]


def test_unknown_labels_are_left_out():
    texts = pa.array(["good word"] * 50 + ["foul word"] * 50 + ["foul word"] * 50)
    y = np.array([0.0] * 50 + [1.0] * 50 + [np.nan] * 50)
    chain = Chain.fitted(texts, {"y": y}, np.arange(150) % 3, ChainParams())
    assert chain.chances(chain.rows(*hashes(["foul"])))[0, 0] > 0.8


def test_odd_rows(spark):
    schema = "doc_id int, text string, toxic int, p_toxic string"
    empty = spark.createDataFrame([], schema)
    none = trained(empty, empty, ["toxic"])
    rows = [(1, None, 1, "x"), (2, "", None, "y"), (3, "word " * 50_000, 0, "z"), (3, "word", 0, "z")]
    frame = spark.createDataFrame(rows, schema)
    assert {r.p_toxic for r in chain_scores(frame, none).collect()} == {0.5}
    one = trained(frame, frame, ["toxic"])
    assert len(chain_scores(frame, one).collect()) == 4
    assert chain_scores(frame.where("false"), one).count() == 0


def test_the_sample_holds_different_texts(spark, monkeypatch):
    """A group of copies is one text with the mean of its labels; the limit is exact."""
    rows = [("copied text", k % 2, 1) for k in range(300)] + [(f"text {k}", k % 2, None) for k in range(100)]
    rows = [(k, *row) for k, row in enumerate(rows)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, low int, toxic int").repartition(4)
    more = spark.createDataFrame([(5000 + k, f"unlabelled {k}") for k in range(50)], "doc_id long, text string")
    docs = frame.select("doc_id", "text").unionAll(more)
    seen = {}

    def fitted(texts, labels, fold, p):
        seen.update(texts=texts.to_pylist(), labels=labels)

    monkeypatch.setattr(Chain, "fitted", fitted)
    trained(docs, frame, ["low", "toxic"], ChainParams(sample=40))
    assert len(seen["texts"]) == len(set(seen["texts"])) == 40
    trained(docs, frame, ["low", "toxic"], ChainParams(sample=1000))
    at = seen["texts"].index("copied text")
    assert len(seen["texts"]) == 101 and seen["labels"]["low"][at] == 0.5 and seen["labels"]["toxic"][at] == 1
    assert np.isnan(seen["labels"]["toxic"]).sum() == 100


def test_nothing_is_toxic_without_a_fitted_model(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string, low_quality int, toxic int")
    none = trained(empty, empty, ["low_quality", "toxic"])
    monkeypatch.setattr(queries, "trained", lambda *_: none)
    assert queries.op9_classifier_chain(spark, "/root/testdata/sf0.001").where("toxic").count() == 0


def plain_words(text):
    marks = {k: " " for k in range(33, 127) if not chr(k).isalnum()}
    return set(re.sub("[A-Z]", lambda m: m[0].lower(), text).translate(marks).split())


def plain_fit(x, earlier, y, use, p):
    """Dense logistic regression of one category on the rows ``use``, step by step."""
    ones, n1, n = (y > 0.5) & use, ((y > 0.5) & use).sum(), use.sum()
    has = x > 0
    a, b, share = has[ones].sum(0) / n1, has[use & ~ones].sum(0) / (n - n1), has[use].sum(0) / n
    told = np.abs(a - b) > p.z * np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)))
    full = np.column_stack([x, earlier, np.ones(len(x))])
    free = np.append(told, np.ones(earlier.shape[1] + 1, bool))
    decay = np.append(np.full(x.shape[1], p.decay), np.zeros(earlier.shape[1] + 1))
    w = np.zeros(full.shape[1])
    mean, scale = w.copy(), w.copy()
    for step in range(1, p.rounds + 1):
        error = (1 / (1 + np.exp(-np.clip(full[use] @ w, -30, 30))) - y[use]) / n
        slope = np.where(free, full[use].T @ error + decay * w, 0)
        mean, scale = 0.9 * mean + 0.1 * slope, 0.999 * scale + 0.001 * slope**2
        w = w - p.rate * (mean / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-8)
    return lambda x, earlier: 1 / (1 + np.exp(-np.clip(np.column_stack([x, earlier, np.ones(len(x))]) @ w, -30, 30)))


def test_chain_fold_by_fold():
    """The chain against dense matrices: each fold's chances come from the other folds and feed the next category."""
    draw = random.Random(3)
    p = ChainParams(rounds=60, least=3, z=2.0, folds=3)
    texts, one, two, three = [], [], [], []
    for k in range(240):
        a, b = draw.random() < 0.4, draw.random() < 0.3
        words = [draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(0, 9))]
        words += [draw.choice(["Bad!", "worse", "(vile)"])] * (a and draw.random() < 0.9) + [draw.choice(["spam", "ads"])] * (b and draw.random() < 0.8)
        draw.shuffle(words)
        texts.append(" ".join(words) if k else None)
        one.append(float(a))
        two.append(float(a or b) if draw.random() < 0.9 else np.nan)
        three.append(float(b and not a))
    labels = {"one": np.array(one), "two": np.array(two), "three": np.array(three)}
    fold = np.array([draw.randrange(p.folds) for _ in texts])
    found = [plain_words(t or "") for t in texts]
    counts = {w: sum(w in f for f in found) for w in set().union(*found)}
    known_words = sorted(w for w, n in counts.items() if n >= p.least)
    dense = lambda sets: np.array([[np.log((len(texts) + 1) / counts[w]) * (w in f) for w in known_words] for f in sets])
    logit = lambda q: np.log(np.clip(q, 1e-6, 1 - 1e-6) / (1 - np.clip(q, 1e-6, 1 - 1e-6)))
    new = ["bad spam a", "worse", "ads b c", "", "unheard of", "vile ads p"]
    x, other = dense(found), dense([plain_words(t) for t in new])
    earlier, chances = np.zeros((len(x), 0)), np.zeros((len(new), 0))
    for y in labels.values():
        known, truth = ~np.isnan(y), np.nan_to_num(y)
        outside = np.zeros(len(x))
        for k in range(p.folds):
            outside[fold == k] = plain_fit(x, earlier, truth, known & (fold != k), p)(x, earlier)[fold == k]
        last = plain_fit(x, earlier, truth, known, p)(other, logit(chances))
        earlier, chances = np.column_stack([earlier, logit(outside)]), np.column_stack([chances, last])
    chain = Chain.fitted(pa.array(texts), labels, fold, p)
    assert len(chain.vocabulary) == len(known_words)
    np.testing.assert_allclose(chain.chances(chain.rows(*hashes(new))), chances, atol=1e-6)
    assert np.ptp(chances, axis=0).min() > 0.1
