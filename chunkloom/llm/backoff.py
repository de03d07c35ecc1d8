"""Stupid-backoff scores of whole texts against the n-gram counts of all of them.

Texts are dealt into parts of bounded size. A part lists its distinct n-grams of all orders with their
local counts, by 64-bit hash; the lists are the map-side combine of the count tables, whose buckets are
ranges of hashes. A bucket adds up its n-grams over all parts and sends every part the totals of
what it listed, in the order of the list. Words and pairs are counted first; a longer n-gram can only be frequent
if both n-grams within it are, so only those are listed in a next round. Parts then join the totals to their
exploded n-grams and sum per document. A word that every document uses is one entry per part, so no key is hot.

Scores are sums of whole millionths: ``L(x) = round(1e6 ln x)`` of counts, which makes them exact
and independent of the order of addition.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.repeats import pack, unpack
from chunkloom.llm.text import BLOCK, LOWER, blocks, mix, prefix_hashes, span_hashes, word_spans
from chunkloom.session import materialize

#: Bytes of text per part and bucket.
SHARE = 5 << 20


@dataclass(frozen=True)
class BackoffParams:
    """``order`` words at most; n-grams of two or more words count from ``least`` occurrences on; each step
    back costs the factor ``penalty``."""

    order: int = 3
    least: int = 2
    penalty: float = 0.4


def log(x: np.ndarray | float) -> np.ndarray:
    return np.rint(1e6 * np.log(x)).astype(np.int64)


def slim(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and those of 255 or more in full."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def full(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[small == 255] = large
    return out


def part_words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of a column of texts, and each text's first word."""
    found, counts = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in blocks(column, BLOCK):
        lowered = LOWER[data]
        starts, ends, bounds = word_spans(lowered, offsets)
        found.append(span_hashes(prefix_hashes(lowered), starts, ends))
        counts.append(np.diff(bounds))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), np.cumsum(np.concatenate(counts))


def n_grams(words: np.ndarray, bounds: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hash of the n-gram that ends at every word, and whether the text has one there."""
    place = np.arange(len(words)) - np.repeat(bounds[:-1], np.diff(bounds))
    out, run = [], np.zeros(len(words), np.uint64)
    for n in range(order):
        # Words further back come first into the hash, each with its own multiplier.
        earlier = np.roll(words, n) if n else words
        run = mix(run * np.uint64(0x9FB21C651E98DF25) + earlier + np.uint64(n + 1))
        out.append((run, place >= n))
    return out


def delta(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted hashes as the first one and steps: four low bytes, two single high ones, and steps of 2^48 or more in full."""
    steps = np.diff(keys, prepend=keys[:1])
    wide = steps >= 1 << 48  # for short lists only
    high = (steps >> np.uint64(32)).astype(np.uint16)
    return keys[:1], steps.astype(np.uint32), high.astype(np.uint8), (high >> 8).astype(np.uint8), np.flatnonzero(wide), steps[wide]


def undelta(start: np.ndarray, low: np.ndarray, mid: np.ndarray, high: np.ndarray, at: np.ndarray, wide: np.ndarray) -> np.ndarray:
    steps = low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(40))
    steps[at] = wide
    return start[0] + np.cumsum(steps)


def _keys(table: pa.Table, order: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    words, bounds = part_words(table.column("text"))
    grams = n_grams(words, bounds, order)
    return [h for h, _ in grams], [ok for _, ok in grams], words, bounds


def rounds(order: int) -> list[list[int]]:
    """The lengths that are counted together: words and pairs first, then one length after the other."""
    return [[1, 2][:order], *([n] for n in range(3, order + 1))]


def _counts(answers: pa.Table, keys: list[np.ndarray], there: list[np.ndarray], p: BackoffParams, known: int) -> list[np.ndarray]:
    """The total of the n-gram that ends at every word for the first ``known`` rounds; 0 where it has none, or is known to
    occur too seldom because one of its parts does."""
    count: list[np.ndarray] = []
    for turn, sizes in enumerate(rounds(p.order)[:known]):
        use = [_open(count, there, n, p) for n in sizes]
        wanted = np.concatenate([keys[n - 1][ok] for n, ok in zip(sizes, use, strict=True)])
        own = answers.filter(pa.array(answers.column("turn").to_numpy() == turn)).sort_by("bucket")
        totals = [full(*unpack(x.as_py(), "u1", "i8")) for x in own.column("totals")]
        where = np.unique(wanted, return_inverse=True)[1]
        joined = np.concatenate(totals)[where] if len(where) else np.zeros(0, np.int64)
        at = 0
        for ok in use:
            found = np.zeros(len(ok), np.int64)
            found[ok] = joined[at : at + ok.sum()]
            at += int(ok.sum())
            count.append(found)
    return count


def _open(count: list[np.ndarray], there: list[np.ndarray], n: int, p: BackoffParams) -> np.ndarray:
    """The places whose n-gram may occur ``p.least`` times: both its parts, without the last word and without the first, do."""
    if n < 3:
        return there[n - 1]
    often = count[n - 2] >= p.least
    return there[n - 1] & often & np.roll(often, 1)


def _listed(table: pa.Table, answers: pa.Table | None, turn: int, p: BackoffParams, buckets: int) -> pa.Table:
    """A part's distinct n-grams of a round with counts, a row per bucket."""
    keys, there, _, _ = _keys(table, p.order)
    count = _counts(answers, keys, there, p, turn) if turn else []
    sizes = rounds(p.order)[turn]
    distinct, counts = np.unique(np.concatenate([keys[n - 1][_open(count, there, n, p)] for n in sizes]), return_counts=True)
    bucket = ((distinct >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # grows with the hash
    held, first = np.unique(bucket, return_index=True)
    rows = []
    for at, end in zip(first, np.append(first[1:], len(distinct))[: len(first)], strict=True):
        rows.append(pack(*delta(distinct[at:end]), *slim(counts[at:end])))
    part = [table.column("part")[0].as_py()] * len(rows) if len(table) else []
    return pa.table({"bucket": pa.array(held if len(table) else [], pa.int32()), "part": pa.array(part, pa.int32()), "listed": pa.array(rows, pa.binary())})


def _totals(table: pa.Table) -> pa.Table:
    """A bucket's totals for each part's list."""
    lists, counts = [], []
    for raw in table.column("listed"):
        *coded, small, large = unpack(raw.as_py(), "u8", "u4", "u1", "u1", "i8", "u8", "u1", "i8")
        lists.append(undelta(*coded))
        counts.append(full(small, large))
    keys, where = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)[where]
    rows = [pack(*slim(x)) for x in np.split(total, np.cumsum([len(x) for x in lists])[:-1])]
    return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "totals": pa.array(rows, pa.binary())})


ADDED = [T.StructField(n, T.LongType()) for n in ("n_words", "level_sum", *(f"level_{k}" for k in range(1, 10)))]


def _scored(texts: pa.Table, answers: pa.Table, names: list[str], p: BackoffParams) -> pa.Table:
    keys, there, words, bounds = _keys(texts, p.order)
    count = _counts(answers, keys, there, p, len(rounds(p.order)))
    level = np.ones(len(words), np.int64)
    for n in range(2, p.order + 1):
        level[there[n - 1] & (count[n - 1] >= p.least)] = n
    sums = np.zeros(len(words), np.int64)
    best = np.sum(there, axis=0)  # the longest n-gram that a place has
    for n in range(1, p.order + 1):
        at = np.flatnonzero(level == n)
        sums[at] = log(count[n - 1][at]) if len(at) else 0
        if n > 1 and len(at):
            sums[at] -= log(count[n - 2][at - 1])
    sums += (best - level) * log(p.penalty)
    per_text = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
    columns = [texts.column(name) for name in names]
    columns += [pa.array(x, pa.int64()) for x in (np.diff(bounds), per_text(sums), *(per_text(level == k) for k in range(1, p.order + 1)))]
    return pa.table(columns, names=[*names, *(f.name for f in ADDED[: p.order + 2])])


def backoff_scores(
    docs: DataFrame, p: BackoffParams = BackoffParams(), text: str = "text", doc_id: str = "doc_id", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``n_words``, ``level_1`` ... (words scored by n-grams
    of that length), ``score_micro`` (sum over the words) and ``score`` (mean natural logarithm per word).

    A word is scored by the longest n-gram ending there that occurs often enough: its count by that of
    the n-gram without the last word; a single word by the number of all words. A null text and one
    without words have a sum of 0 and a null mean. Rows that repeat are counted as often as they occur. An
    empty table gives no rows; columns of ``docs`` named like an added one are replaced.
    """
    levels = [f"level_{k}" for k in range(1, p.order + 1)]
    own = {"n_words", "score", "score_micro", "level_sum", *levels}
    names = [c for c in (docs.columns if keep is None else keep) if c not in own]
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // SHARE))
    rows = docs.select(
        F.struct(*names).alias("doc"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("int").alias("part")
    )
    shape = "bucket int, part int, listed binary"
    again = lambda turn: lambda texts, found: _listed(texts, found, turn, p, n)
    answers = None
    for turn in range(len(rounds(p.order))):
        if answers is None:
            listed = rows.groupBy("part").applyInArrow(lambda t: _listed(t, None, 0, p, n), shape)
        else:
            listed = rows.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(again(turn), shape)
        totals = listed.groupBy("bucket").applyInArrow(_totals, "part int, bucket int, totals binary")
        totals = materialize(totals, "totals").withColumn("turn", F.lit(turn))
        answers = totals if answers is None else answers.unionAll(totals)
    schema = T.StructType([rows.schema["doc"], *ADDED[: p.order + 2]])
    scored = (
        rows.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(lambda a, b: _scored(a, b, ["doc"], p), schema)
    )
    scored = materialize(scored, "scored")
    words = scored.agg(F.sum("n_words")).first()[0] or 1
    micro = F.col("level_sum") - F.col("level_1") * F.lit(int(log(words)))
    return scored.select(
        "doc.*", "n_words", *levels, micro.alias("score_micro"),
        F.when(F.col("n_words") > 0, micro / F.lit(1e6) / F.col("n_words")).alias("score"),
    )


BACKOFF_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS ws FROM documents)),
g AS (
  SELECT doc_id, i, w, lag(w) OVER d AS v, lag(w, 2) OVER d AS u FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, count(*) OVER (PARTITION BY w) AS cw, count(*) OVER (PARTITION BY v, w) AS cvw,
         count(*) OVER (PARTITION BY u, v, w) AS cuvw, count(*) OVER () AS n FROM g),
x AS (
  SELECT *, lag(cw) OVER d AS cv, lag(cvw) OVER d AS cuv,
         CASE WHEN i > 2 AND cuvw >= 2 THEN 3 WHEN i > 1 AND cvw >= 2 THEN 2 ELSE 1 END AS level
  FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
l AS (
  SELECT doc_id, level, (least(i, 3) - level) * round_even(1e6 * ln(0.4), 0)::BIGINT + CASE level
    WHEN 3 THEN round_even(1e6 * ln(cuvw), 0)::BIGINT - round_even(1e6 * ln(cuv), 0)::BIGINT
    WHEN 2 THEN round_even(1e6 * ln(cvw), 0)::BIGINT - round_even(1e6 * ln(cv), 0)::BIGINT
    ELSE round_even(1e6 * ln(cw), 0)::BIGINT - round_even(1e6 * ln(n), 0)::BIGINT END AS m FROM x),
s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2,
         count(*) FILTER (level = 3) AS level_3, sum(m)::BIGINT AS score_micro FROM l GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(level_1, 0) AS level_1, coalesce(level_2, 0) AS level_2,
       coalesce(level_3, 0) AS level_3, coalesce(score_micro, 0) AS score_micro,
       score_micro::DOUBLE / 1e6 / n_words AS score
FROM documents LEFT JOIN s USING (doc_id)
"""
