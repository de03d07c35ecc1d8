"""Batch embedding of chunk texts with a pluggable embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = ("mean", "first_line", "concat")
#: Lines embedded at once: the matrices of a batch of many short lines are far larger than its texts.
LINES = 4096
DEFAULT_MODEL = "hash-64"


class Embedder(Protocol):
    """What a model has to offer; instances are pickled to the Python workers."""

    name: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row of ``dims`` float64 values per text."""
        ...


class _WordCodes(dict):
    """Word to code, computed on first sight; bounded so that a worker's memory is too."""

    LIMIT = 1 << 16

    def __init__(self, width: int) -> None:
        self.width = width

    def __missing__(self, word: str) -> int:
        code = int(hashlib.md5(word.encode("utf-8")).hexdigest()[:8], 16) % self.width
        if len(self) < self.LIMIT:
            self[word] = code
        return code


class HashEmbedder:
    """Signed feature hashing of lower-cased words, scaled to length 1.

    Needs no model file and gives the same vectors on every machine: the first 32 bits of
    the word's MD5 choose the dimension (remainder by ``dims``) and the sign (parity of the
    quotient). A text without words has the zero vector.
    """

    def __init__(self, dims: int = 64) -> None:
        if dims < 1:
            raise ValueError("dims must be at least 1")
        self.dims = dims
        self.name = f"hash-{dims}"
        self._codes = _WordCodes(2 * dims)

    def __reduce__(self):
        return HashEmbedder, (self.dims,)

    def embed(self, texts: list[str]) -> np.ndarray:
        if len(texts) > LINES:
            return np.concatenate([self.embed(texts[at : at + LINES]) for at in range(0, len(texts), LINES)])
        codes: list[int] = []
        sizes = []
        for text in texts:
            text = text.lower()
            for blank in "\t\r\n\f\v":
                text = text.replace(blank, " ")
            words = [w for w in text.split(" ") if w]
            codes += map(self._codes.__getitem__, words)
            sizes.append(len(words))
        width = 2 * self.dims
        slots = np.repeat(np.arange(len(texts)) * width, sizes) + np.array(codes, np.int64)
        counts = np.bincount(slots, minlength=len(texts) * width).reshape(len(texts), 2, self.dims)
        sums = (counts[:, 0] - counts[:, 1]).astype(np.float64)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)


_FACTORIES: dict[str, Callable[[], Embedder]] = {
    "hash-64": lambda: HashEmbedder(64),
    "hash-256": lambda: HashEmbedder(256),
    "hash-384": lambda: HashEmbedder(384),
}


def register_model(name: str, factory: Callable[[], Embedder]) -> None:
    """Make an embedder available by name."""
    _FACTORIES[name] = factory


def model(name: str) -> Embedder:
    """The registered embedder of that name, else the default one."""
    return _FACTORIES.get(name, _FACTORIES[DEFAULT_MODEL])()


def _embed_texts(texts: list[str], embedder: Embedder, batch: int | None) -> np.ndarray:
    """Vectors of texts, the model called with at most ``batch`` of them at a time."""
    size = batch or max(1, len(texts))
    return np.concatenate([embedder.embed(texts[at : at + size]) for at in range(0, len(texts) or 1, size)])


def _embed_rows(rows: pa.ListArray, embedder: Embedder, policy: str, batch: int | None = None) -> np.ndarray:
    """Vectors of an array of line lists."""
    if policy == "concat":
        return _embed_texts(["\n".join(lines or ()) for lines in rows.to_pylist()], embedder, batch)
    offsets = rows.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    lines = [line or "" for line in rows.flatten().to_pylist()]
    full = np.flatnonzero(sizes)
    out = np.zeros((len(rows), embedder.dims))
    if not len(full):
        return out
    if policy == "first_line":
        out[full] = _embed_texts([lines[i] for i in offsets[:-1][full]], embedder, batch)
        return out
    # Overlapping chunks share lines: embed each distinct line of the batch once.
    index: dict[str, int] = {}
    inverse = [index.setdefault(line, len(index)) for line in lines]
    vectors = _embed_texts(list(index), embedder, batch)[inverse]
    out[full] = np.add.reduceat(vectors, offsets[:-1][full], axis=0) / sizes[full, None]
    return out


def _parts(rows: pa.ListArray) -> Iterator[pa.ListArray]:
    """The array in parts of ``LINES`` lines at most, or one list; an empty array is one part."""
    offsets, at = rows.offsets.to_numpy().astype(np.int64), 0
    while at < len(rows) or not at:
        end = min(len(rows), max(at + 1, int(np.searchsorted(offsets, offsets[at] + LINES, side="right")) - 1))
        yield rows.slice(at, end - at)
        at = max(end, 1)


def embed_lines(text: Column, embedder: Embedder, policy: str = "mean", batch: int | None = None) -> Column:
    """Vector of an ``array<string>`` column.

    ``mean`` averages the line vectors, ``first_line`` takes the first line's vector and
    ``concat`` embeds the joined text. Arrow batches go to the workers, which call the model
    with at most ``batch`` texts; the result does not depend on either size.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}, expected one of {POLICIES}")

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            if rows.null_count:
                rows = pa.array([lines or [] for lines in rows.to_pylist()], pa.list_(pa.string()))
            matrix = np.concatenate([_embed_rows(part, embedder, policy, batch) for part in _parts(rows)])
            ends = np.arange(0, matrix.size + 1, embedder.dims, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)))

    return vectors(text)


def embed_chunks(
    chunks: DataFrame, embedder: Embedder, policy: str = "mean", batch: int | None = None
) -> DataFrame:
    """Replace ``text`` by ``embedding``; the dimension and the model go into the column's metadata."""
    meta = {"ndims": embedder.dims, "model": embedder.name, "policy": policy}
    vector = embed_lines(F.col("text"), embedder, policy, batch).alias("embedding", metadata=meta)
    return chunks.select(*[c for c in chunks.columns if c != "text"], vector)


def embed_queries(queries: DataFrame, embedder: Embedder, policy: str = "mean") -> DataFrame:
    """``(query_id, text)`` to ``(query_id, embedding)`` with the table's model."""
    from chunkloom.operators.lines import line_array

    return queries.select("query_id", embed_lines(line_array(F.col("text")), embedder, policy).alias("embedding"))


def check_dims(chunks: DataFrame, ndims: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose embedding has ``ndims`` values, and the others."""
    ok = F.coalesce(F.size("embedding") == ndims, F.lit(False))
    return chunks.filter(ok), chunks.filter(~ok)


def check_model(chunks: DataFrame, embedder: Embedder, policy: str | None = None) -> None:
    """Raise if a table was embedded by another model than ``embedder``, or by another ``policy``."""
    meta = chunks.schema["embedding"].metadata or {}
    wanted = {"model": embedder.name, "ndims": embedder.dims, "policy": policy}
    if any(v is not None and meta.get(k, v) != v for k, v in wanted.items()):
        raise ValueError(f"the table was embedded by {meta}, the query by {embedder.name}")
