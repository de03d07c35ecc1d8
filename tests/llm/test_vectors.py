"""Vector links against all pairs."""

import numpy as np
import pytest

from chunkloom.llm.quantised import QuantParams, Quantiser, embedding_duplicates


def by_hand(rows, least=0.98):
    good = []
    for i, x, label in rows:
        ok = i is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x)
        good.append(np.array(x, float) if ok else None)
    n, parent = [0] * len(rows), {}

    def top(k):
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(len(rows)):
            x, y = good[a], good[b]
            if a != b and x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    n[a] += 1
                    low, high = sorted((top(rows[a][0]), top(rows[b][0])))
                    parent[high] = low
    return sorted((r[0], n[k], top(r[0])) for k, r in enumerate(rows))


def found(spark, rows, p=QuantParams()):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    return sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_duplicates(frame, p).collect())


@pytest.mark.parametrize("per_list", [5, 400])
def test_clusters(spark, per_list):
    draw = np.random.default_rng(per_list)
    rows = []
    for label in (0, 1):
        for centre in draw.normal(size=(12, 16)):
            for _ in range(draw.integers(1, 9)):
                rows.append((len(rows) * 5 % 997, (centre + draw.normal(size=16) * draw.choice([0.0, 0.1, 0.2])).tolist(), label))
    rows += [(1000 + k, draw.normal(size=16).tolist(), 1) for k in range(30)]
    p = QuantParams(per_list=per_list, subspaces=4, words=8, tile=7)
    assert found(spark, rows, p) == by_hand(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [2.0, 0.01], 1), (4, [2.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [-1.0, 0.0], 1), (12, [1.0], 1), (13, [inf, 1.0], 1), (14, [1e200, 0.0], 1),
    ]
    assert found(spark, rows[:-1]) == by_hand(rows[:-1])
    assert (14, 3, 1) in found(spark, rows)
    assert found(spark, []) == []


def test_a_repeated_id_counts_by_its_vectors_and_labels(spark):
    one = [1.0, 0.0]
    rows = [(5, one, 1), (5, one, 2), (8, one, 1), (9, [1.0, 0.001], 1), (5, [0.0, 1.0], 1), (7, one, 3), (8, [0.0, 2.0], 1)]
    assert found(spark, rows) == sorted([(5, 2, 5), (5, 0, 5), (8, 2, 5), (9, 2, 5), (5, 1, 5), (7, 0, 7), (8, 1, 5)])


def test_lookups_and_probes_lose_nothing():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    quantiser = Quantiser.trained(x, 20, QuantParams(subspaces=3, words=16))
    lists, codes, errors = quantiser.coded(x)
    reach = 0.6
    probed = quantiser.probes(x, lists, reach)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= reach
    assert all(probed[i, lists[j]] for i, j in zip(*np.nonzero(near)))
    assert not probed.all()
    for c in range(len(quantiser.centres)):
        of = lists == c
        far = np.sqrt(quantiser.looked_up(x, c, codes[of]))
        true = np.sqrt(((x[:, None] - x[of][None]) ** 2).sum(-1))
        assert (np.abs(far - true) <= errors[of][None, :] + 1e-6).all()
