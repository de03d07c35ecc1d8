"""What a batch of many short lines holds at once while it is embedded."""

import tracemalloc

import numpy as np
import pyarrow as pa

from chunkloom.operators.embedding import LINES, HashEmbedder, _embed_rows, _parts


def test_many_lines_are_embedded_in_parts():
    texts = [f"word{k} and more" for k in range(20 * LINES)]
    embedder = HashEmbedder(64)
    tracemalloc.start()
    got = embedder.embed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * got.nbytes + 50_000_000
    assert len(embedder._codes) <= 1 << 16
    some = [0, LINES - 1, LINES, 20 * LINES - 1]
    assert (got[some] == HashEmbedder(64).embed([texts[k] for k in some])).all()


def test_parts_hold_every_list():
    lists = [["a b"], [], ["c"] * (LINES + 5), ["d", "e"], *[["f", None, "g h"]] * LINES, []]
    rows = pa.array([["skipped"], *lists], pa.list_(pa.string())).slice(1)
    parts = list(_parts(rows))
    assert [x for p in parts for x in p.to_pylist()] == lists and len(parts) > 3
    assert all(len(p) == 1 or len(p.flatten()) <= LINES for p in parts)
    got = np.concatenate([_embed_rows(p, HashEmbedder(8), "mean") for p in parts])
    assert (got == _embed_rows(rows, HashEmbedder(8), "mean")).all()
    assert [len(p) for p in _parts(pa.array([], pa.list_(pa.string())))] == [0]
