"""Toxicity by a classifier chain: linear models of one category after the other.

A model sees which words of its vocabulary a text holds, weighted by their rarity, and the
probabilities of the categories before its own. For training these come from folds: a row's
probability is that of models fitted without the row's fold, so that a later model learns how far an
earlier one can be trusted. Models are fitted on a bounded sample; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.text import LOWER, blocks, prefix_hashes, sets, span_hashes, word_spans


@dataclass(frozen=True)
class ChainParams:
    """``sample`` labelled texts at most are fitted on. A word needs ``least`` of them, and a model
    uses it if its share differs between the classes by ``z`` standard errors."""

    sample: int = 8000
    folds: int = 4
    least: int = 4
    z: float = 4.5
    rounds: int = 250
    rate: float = 0.1
    decay: float = 1e-5
    threshold: float = 0.5


def distinct_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, bounds): each text's distinct lower-case words without marks around them."""
    mark = np.zeros(256, dtype=bool)
    mark[[k for k in range(33, 127) if not chr(k).isalnum()]] = True
    for first, end, data, offsets in blocks(column):
        lowered = LOWER[data]
        lowered = np.where(mark[lowered], np.uint8(32), lowered)
        starts, ends, bounds = word_spans(lowered, offsets)
        hashes = span_hashes(prefix_hashes(lowered), starts, ends)
        yield first, end, *sets(hashes, np.repeat(np.arange(end - first), np.diff(bounds)), end - first)


class Rows:
    """A sparse matrix of 0/1 entries, weighted by column, with a few dense columns at the end."""

    def __init__(self, columns: np.ndarray, bounds: np.ndarray, weights: np.ndarray) -> None:
        self.columns, self.weights = columns, weights
        self.owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.n = len(bounds) - 1

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=(w * self.weights)[self.columns], minlength=self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=r[self.owner], minlength=len(self.weights)) * self.weights

    def telling(self, y: np.ndarray, use: np.ndarray, least: float) -> np.ndarray:
        """Flags of the columns whose share differs between the classes by ``least`` standard errors."""
        ones, all_ = (y > 0.5) & use, use
        n1, n = ones.sum(), all_.sum()
        if not 0 < n1 < n:
            return np.zeros(len(self.weights), dtype=bool)
        with_1, with_any = (np.bincount(self.columns, weights=k[self.owner], minlength=len(self.weights)) for k in (ones, all_))
        share = with_any / n
        apart = np.abs(with_1 / n1 - (with_any - with_1) / (n - n1))
        return apart > least * np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    """Weights of the words, of the earlier categories' logits, and an offset."""

    words: np.ndarray
    earlier: np.ndarray
    offset: float

    @classmethod
    def fitted(cls, rows: Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, p: ChainParams) -> Linear:
        """Logistic regression on the rows ``use`` by moment-scaled gradient steps; deterministic."""
        size = len(rows.weights)
        told = rows.telling(y, use, p.z)
        x = np.zeros(size + earlier.shape[1] + 1)
        mean, scale = np.zeros_like(x), np.zeros_like(x)
        share = use / max(1, use.sum())
        for step in range(1, p.rounds + 1):
            score = rows.times(x[:size]) + earlier @ x[size:-1] + x[-1]
            error = (sigmoid(score) - y) * share
            grad = np.concatenate([rows.back(error), earlier.T @ error, [error.sum()]])
            grad[:size] = (grad[:size] + p.decay * x[:size]) * told
            mean = 0.9 * mean + 0.1 * grad
            scale = 0.999 * scale + 0.001 * grad**2
            x -= p.rate * (mean / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.999**step)) + 1e-8)
        return cls(x[:size], x[size:-1], float(x[-1]))

    def chance(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(rows.times(self.words) + earlier @ self.earlier + self.offset)


@dataclass
class Chain:
    """The vocabulary (sorted hashes and weights) and a model per category, in order."""

    categories: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    models: list[Linear] = field(default_factory=list)

    def rows(self, hashes: np.ndarray, bounds: np.ndarray) -> Rows:
        if not len(self.vocabulary):
            return Rows(np.zeros(0, np.int64), np.zeros(len(bounds), np.int64), self.weights)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        use = self.vocabulary[at] == hashes
        return Rows(at[use], np.append(0, np.cumsum(use))[bounds], self.weights)

    def chances(self, rows: Rows) -> np.ndarray:
        """A column of probabilities per category."""
        out = np.zeros((rows.n, 0))
        for model in self.models:
            out = np.column_stack([out, model.chance(rows, logit(out))])
        return out

    @classmethod
    def fitted(cls, texts: pa.Array, labels: dict[str, np.ndarray], fold: np.ndarray, p: ChainParams) -> Chain:
        """A chain over the labels in order; a label's NaN rows are left out of its own model."""
        parts = list(distinct_words(texts))
        hashes = np.concatenate([x[2] for x in parts]) if parts else np.zeros(0, np.uint64)
        bounds = np.append(0, np.cumsum(np.concatenate([np.diff(x[3]) for x in parts]))) if parts else np.zeros(1, np.int64)
        words, found = np.unique(hashes, return_counts=True)
        words, found = words[found >= p.least], found[found >= p.least]
        chain = cls(list(labels), words, np.log((len(texts) + 1) / found) if len(words) else np.zeros(0))
        rows = chain.rows(hashes, bounds)
        earlier = np.zeros((rows.n, 0))
        for y in labels.values():
            known = ~np.isnan(y)
            truth = np.where(known, y, 0.0)
            outside = np.zeros(rows.n)
            for k in range(p.folds):
                model = Linear.fitted(rows, earlier, truth, known & (fold != k), p)
                outside[fold == k] = model.chance(rows, earlier)[fold == k]
            chain.models.append(Linear.fitted(rows, earlier, truth, known, p))
            earlier = np.column_stack([earlier, logit(outside)])
        return chain


def trained(docs: DataFrame, labels: DataFrame, categories: Sequence[str], p: ChainParams = ChainParams(), text: str = "text", on: str = "doc_id") -> Chain:
    """A chain from texts and a table of labels: the column ``on`` and a 0/1 (or null) column per category.

    The sample is the ``p.sample`` different texts with the smallest hashes, or all; only it reaches the driver. Labels
    meet hashes of texts; the texts drawn are then picked from ``docs`` by a list of at most that many hashes. A
    text with copies counts once, with the mean of their labels. Folds go by the same hash. Without rows every
    chance is one half.
    """
    some = F.lit(False)
    for name in categories:
        some = some | F.col(name).isNotNull()
    marks = labels.where(some).select(F.col(on).alias("of"), *(F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(on).alias("of"), F.xxhash64(text).alias("unit"), F.col(text).alias("text"))
    means = [F.avg(f"y{k}").alias(f"y{k}") for k in range(len(categories))]
    drawn = texts.select("of", "unit").join(marks, "of").groupBy("unit").agg(*means).orderBy("unit").limit(p.sample).toArrow()
    units = F.broadcast(docs.sparkSession.createDataFrame(drawn.select(["unit"])))  # p.sample numbers at most
    whole = texts.join(units, "unit", "left_semi").groupBy("unit").agg(F.first("text").alias("text"))
    table = drawn.join(whole.toArrow(), "unit").sort_by("unit")
    found = {c: table.column(f"y{k}").to_numpy().astype(float) for k, c in enumerate(categories)}
    fold = np.mod(table.column("unit").to_numpy(), p.folds)
    return Chain.fitted(table.column("text").combine_chunks(), found, fold, p)


def chain_scores(docs: DataFrame, chain: Chain, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and ``p_<category>`` for each category.

    Texts are read whole. A null text and one without words get the chance of a text of which nothing is
    known. Rows are independent; columns named like an added one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    added = [f"p_{c}" for c in chain.categories]
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(F.struct(*names).alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for first, end, hashes, bounds in distinct_words(batch.column(1)):
                found = model.chances(model.rows(hashes, bounds))
                columns = [batch.column(0).slice(first, end - first), *(pa.array(np.ascontiguousarray(x)) for x in found.T)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", *added])

    schema = T.StructType([rows.schema["doc"], *(T.StructField(a, T.DoubleType()) for a in added)])
    return rows.mapInArrow(run, schema).select("doc.*", *added)
