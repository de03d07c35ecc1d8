"""Language by cross-parsing: which language's text describes a document in the fewest phrases.

For each language a suffix automaton of a bounded sample of labelled text accepts just the substrings
of that sample. A document is cut greedily into the longest phrases that the automaton knows; a
phrase costs the logarithm of the sample's length, and the language with the least cost per letter wins.

The automata are dense tables; all segments of a batch walk through all languages' tables in step,
so a letter costs a few array look-ups. A phrase does not run over a segment's end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT = 2048
LETTERS = 1 << 22
#: Codes of the letters table: no letter (white space, digits, marks), and a letter no sample has.
GAP = 0


@dataclass(frozen=True)
class ParseParams:
    """The sample per language: ``texts`` different texts or more if it has them (all if not), ``take`` letters of
    each, from ``windows`` places spread over the whole text, and ``letters`` in all."""

    texts: int = 400
    take: int = 2000
    letters: int = 60_000
    windows: int = 8


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def letters_only(points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with every run of other characters as one 0, none at a text's start; and the new edges."""
    kinds, where = np.unique(points, return_inverse=True)
    alpha = np.array([chr(k).isalpha() if not 0xD800 <= k < 0xE000 else False for k in kinds.tolist()], dtype=bool)
    letter = alpha[where] if len(points) else np.zeros(0, dtype=bool)
    before = np.append(False, letter[:-1])
    before[edges[:-1][edges[:-1] < len(points)]] = False
    keep = letter | before[: len(letter)]
    kept = np.append(0, np.cumsum(keep))
    return np.where(letter, points, GAP)[keep], kept[edges]


def spread(found: np.ndarray, take: int, windows: int) -> np.ndarray:
    """At most ``take`` letters of a text: all of them, or evenly spaced windows, the first one at its start
    and the last one at its end, with a gap after each."""
    windows = max(1, min(windows, take))
    if len(found) <= take or windows == 1:
        return np.append(found[:take], np.uint32(GAP))
    each = take // windows
    starts = np.linspace(0, len(found) - each, windows).astype(np.int64)
    return np.concatenate([np.append(found[k : k + each], np.uint32(GAP)) for k in starts])


def automaton(codes: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is its start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = state
            at = link[at]
        if at >= 0:
            to = moves[at][code]
            if length[to] != length[at] + 1:
                twin = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = twin
                while at >= 0 and moves[at].get(code) == to:
                    moves[at][code] = twin
                    at = link[at]
                to = twin
            link[state] = to
        last = state
    return moves


class Languages:
    """Automata of several languages in one table: row = state, column = letter, 0 = no transition."""

    def __init__(self, samples: dict[str, np.ndarray]) -> None:
        self.names = sorted(samples)
        known = np.unique(np.concatenate([np.zeros(1, np.uint32), *samples.values()]))
        self.known, self.width = known, len(known) + 1
        rows, roots = [np.zeros((1, self.width), np.int32)], []
        size = 1
        for name in self.names:
            moves = automaton(np.searchsorted(known, samples[name]).tolist())
            table = np.zeros((len(moves), self.width), np.int32)
            for state, to in enumerate(moves):
                table[state, list(to)] = np.fromiter(to.values(), np.int32, len(to)) + size
            roots.append(size)
            rows.append(table)
            size += len(moves)
        self.table = np.concatenate(rows).ravel()
        self.roots = np.array(roots, dtype=np.int64)
        self.price = np.log2([max(2, len(samples[n])) for n in self.names])

    def phrases(self, points: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Numbers of phrases, a row per language and a column per text."""
        place = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
        codes = np.where(self.known[place] == points, place, self.width - 1)
        sizes = np.diff(edges)
        pieces = -(-sizes // SEGMENT)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = edges[:-1][text] + nth * SEGMENT
        length = np.minimum(sizes[text] - nth * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        start, length, text = start[order], length[order], text[order]
        roots = self.roots[:, None]
        counts = np.zeros((len(roots), len(text)), np.int64)
        state = np.broadcast_to(roots, counts.shape).copy()
        active = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for step, n in enumerate(active):
            code = codes[start[:n] + step]
            now = state[:, :n]
            after = self.table[now * self.width + code]
            stop = after == 0
            fresh = self.table[roots * self.width + code]
            counts[:, :n] += stop & (now != roots)
            counts[:, :n] += stop & (fresh == 0)
            state[:, :n] = np.where(stop, np.where(fresh == 0, roots, fresh), after)
        counts += state != roots
        out = np.zeros((len(roots), len(sizes)), np.int64)
        for k in range(len(roots)):
            out[k] = np.bincount(text, weights=counts[k], minlength=len(sizes))
        return out

    def judged(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of texts; ``und`` and 0 without letters or languages."""
        points = [code_points(t) for t in texts]
        edges = np.append(0, np.cumsum([len(p) for p in points]))
        found, edges = letters_only(np.concatenate(points) if points else np.zeros(0, np.uint32), edges)
        sizes = np.diff(edges)
        if not self.names:
            return ["und"] * len(texts), [0.0] * len(texts)
        cost = self.phrases(found, edges) * self.price[:, None]
        best = cost.argmin(axis=0)
        ranked = np.sort(cost, axis=0)
        second = ranked[1] if len(ranked) > 1 else ranked[0] * np.inf
        with np.errstate(invalid="ignore", divide="ignore"):
            score = np.where(np.isfinite(second), second / (ranked[0] + second), 1.0)
        names = [self.names[k] if n else "und" for k, n in zip(best, sizes, strict=True)]
        return names, [float(s) if n else 0.0 for s, n in zip(score, sizes, strict=True)]


def learned(labelled: DataFrame, p: ParseParams = ParseParams(), text: str = "text", lang: str = "lang") -> Languages:
    """Languages from labelled texts. Rows without text or language are left out; equal texts count once.

    Texts are drawn by their hash, with the chance that the number of different texts of their language gives, and
    cut to windows where they are read; what reaches the driver is bounded by ``ParseParams`` for each language.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    unit = F.xxhash64("text")
    counts = rows.select("lang", unit.alias("unit")).distinct().groupBy("lang").count().collect()  # a row per language
    if not counts:
        return Languages({})
    chance = F.create_map(*(F.lit(v) for r in counts for v in (r["lang"], 2.0 * p.texts / r["count"])))
    drawn = rows.where(unit / F.lit(2.0**64) + 0.5 < F.element_at(chance, F.col("lang"))).select("lang", unit.alias("unit"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()  # copies are cut once in a task
        for batch in batches:
            fresh, cuts = [], []
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    points = code_points(batch.column(2)[k].as_py())
                    found, _ = letters_only(points, np.array([0, len(points)]))
                    fresh.append(k)
                    cuts.append(spread(found, p.take, p.windows).astype("<u4").tobytes())
            kept = batch.select([0, 1]).take(pa.array(fresh, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cuts, pa.binary())], names=["lang", "unit", "cut"])

    cut = drawn.mapInArrow(run, T.StructType([*drawn.schema.fields[:2], T.StructField("cut", T.BinaryType())]))
    samples: dict[str, list[np.ndarray]] = {}
    for row in sorted(cut.dropDuplicates(["lang", "unit"]).collect()):
        samples.setdefault(row["lang"], []).append(np.frombuffer(row["cut"], "<u4"))
    # Every drawn text has its share of the letters, in windows over the whole text.
    shares = {k: [spread(x, max(1, p.letters // len(v)), p.windows) for x in v] for k, v in samples.items()}
    return Languages({k: np.concatenate(v)[: p.letters].astype(np.uint32) for k, v in shares.items()})


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def languages_of(docs: DataFrame, model: Languages, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``lang_pred`` and ``score`` (0 to 1).

    A null text and one without a letter are ``und`` with score 0. The score is the runner-up's share in
    the two least costs; ties go to the first name. Rows are independent of each other and of all
    other columns; columns named like an added one are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*names).alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            upto = np.cumsum([len(t) for t in texts]) // LETTERS
            for part in range(int(upto[-1]) + 1 if len(upto) else 0):
                first, end = np.searchsorted(upto, (part, part + 1))
                if first == end:
                    continue
                found, score = shared.value.judged(texts[first:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(found, pa.string()), pa.array(score, pa.float64())],
                    names=["doc", "lang_pred", "score"],
                )

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *ADDED])).select("doc.*", "lang_pred", "score")
