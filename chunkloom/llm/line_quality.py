"""Quality rules: base counts of a text, and lines that too many documents of a host repeat.

Lines are normalised to their lower-case words and hashed. Per host (the ``source`` column) a
line's documents are counted; copies of one document count once, since a document is told by a
hash of all its distinct lines. Lines found in more than ``share`` of the host's documents,
and in ``min_docs`` at least, are removed; a document that keeps too few words is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.salt import join_groups
from chunkloom.llm.text import (
    LOWER,
    SPACE,
    blocks,
    mix,
    powers,
    prefix_hashes,
    span_hashes,
    word_spans,
)
from chunkloom.session import materialize

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """A line goes if it is in more than ``share`` of its host's documents and in ``min_docs`` or
    more; a document goes if under ``min_words`` words or under ``keep_share`` of them are left."""

    min_docs: int = 20
    share: float = 0.01
    min_words: int = 10
    keep_share: float = 0.3


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _runs(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _fresh(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (owner, hash) and the flags of the first of each pair in it."""
    order = np.lexsort((hashes, owner))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return order, first


def line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of the lines of a block of texts."""
    if not len(data):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    breaks = np.flatnonzero(data == 10) + 1
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts = np.union1d(edges, breaks[breaks < len(data)])
    ends = np.append(starts[1:], len(data))
    return starts, ends - (data[ends - 1] == 10)


def word_lines(data: np.ndarray, offsets: np.ndarray):
    """Lines that hold a word: (text number, start, end, first word, end word, normalised hash)."""
    lowered = LOWER[data]
    starts, ends, _ = word_spans(data, offsets)
    words = span_hashes(prefix_hashes(lowered), starts, ends)
    begin, stop = line_starts(data, offsets)
    first = np.searchsorted(starts, begin)
    last = np.append(first[1:], len(starts))
    use = last > first
    begin, stop, first, last = begin[use], stop[use], first[use], last[use]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    return owner, begin, stop, first, last, _runs(words, first, last)


def _measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    texts = len(offsets) - 1
    starts, ends, bounds = word_spans(data, offsets)
    n_words = np.diff(bounds)
    sums = prefix_hashes(data)
    words = span_hashes(sums, starts, ends)
    owner, begin, stop, first, last, normal = word_lines(data, offsets)
    lead = (data & 0xC0) != 0x80

    order, fresh = _fresh(owner, span_hashes(sums, begin, stop))
    lines = np.bincount(owner, minlength=texts)
    n_dup_lines = lines - np.bincount(owner[order][fresh], minlength=texts)

    windows = np.maximum(n_words - WINDOW + 1, 0)
    of = np.repeat(np.arange(texts), windows)
    at = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + bounds[:-1][of]
    order, fresh = _fresh(of, _runs(words, at, at + WINDOW))
    group = np.cumsum(fresh) - 1
    repeated = at[order][np.bincount(group)[group] > 1] if len(of) else at
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, repeated, 1)
    np.subtract.at(cover, repeated + WINDOW, 1)

    order, fresh = _fresh(owner, normal)
    group = np.cumsum(fresh) - 1
    held = owner[order][fresh]
    hashes = normal[order][fresh].view(np.int64)
    counts = np.bincount(group, weights=(last - first)[order]).astype(np.int64) if len(group) else group
    cuts = np.searchsorted(held, np.arange(texts + 1))
    line_set = _runs(normal[order][fresh], cuts[:-1], cuts[1:]).view(np.int64)
    cuts = pa.array(cuts, pa.int32())
    return {
        "n_words": n_words,
        "word_chars": _sums(lead & ~SPACE[data], offsets),
        "n_symbols": _sums(SYMBOLS[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _sums(np.cumsum(cover)[:-1] > 0, bounds),
        "line_set": line_set,
        "lines": pa.ListArray.from_arrays(cuts, pa.array(hashes, pa.int64())),
        "line_words": pa.ListArray.from_arrays(cuts, pa.array(counts, pa.int64())),
    }


MEASURES = T.StructType(
    [
        T.StructField(name, T.LongType())
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_set")
    ]
    + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("lines", "line_words")]
)


def measured(docs: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, per text, its counts, a hash of its set of
    normalised lines, these lines and their words."""
    names = [*keep, *MEASURES.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(text)):
                found = _measure(data, offsets)
                columns = [batch.column(name).slice(first, end - first) for name in keep]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(found[name]) for name in MEASURES.names], names=names
                )

    return docs.mapInArrow(run, T.StructType(docs.select(*keep).schema.fields + MEASURES.fields))


def frequent_lines(texts: DataFrame, limits: LineLimits) -> tuple[DataFrame, DataFrame]:
    """From ``measured`` rows with ``row_id`` and ``host``: their lines as rows (row_id, line_key, line,
    words), and the keys of lines above the limits with the number of their documents.

    Documents are told apart by their sets of lines, those of a line and those of its host, so copies count once.
    Distinct documents are counted in two steps, by (line, document) and then by line from partial
    counts, so that a line found everywhere is no single task.
    """
    hosts = texts.select("host", "line_set").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    rows = join_groups(texts.select("row_id", "host", "line_set", "lines", "line_words"), hosts, "host", "row_id").select(
        "row_id",
        "host",
        "host_docs",
        "line_set",
        F.explode(F.arrays_zip("lines", "line_words")).alias("of"),
    )
    lines = rows.select(
        "row_id",
        "host_docs",
        F.xxhash64("host", "of.lines").alias("line_key"),
        F.col("of.lines").alias("line"),
        F.col("of.line_words").alias("words"),
        "line_set",
    )
    limit = F.greatest(F.lit(limits.min_docs - 1).cast("double"), F.col("host_docs") * F.lit(limits.share))
    hot = (
        lines.groupBy("line_key", "line_set")
        .agg(F.max("host_docs").alias("host_docs"))
        .groupBy("line_key")
        .agg(F.count("*").alias("line_docs"), F.max("host_docs").alias("host_docs"))
        .where(F.col("line_docs") > limit)
        .select("line_key", "line_docs")
    )
    return lines.select("row_id", "line_key", "line", "words"), hot


def line_quality(
    docs: DataFrame,
    limits: LineLimits = LineLimits(),
    text: str = "text",
    host: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the counts, ``removed_words``, ``removed_lines`` (hashes of the
    normalised lines removed), ``base_failed`` and ``kept``.

    Null texts have no words and fail the base rules; a null host is a host of its own. Rows that
    repeat count as documents of one text. Columns of ``docs`` named like an added one are
    replaced. An empty table gives no rows.
    """
    own = {*MEASURES.names[:5], "removed_words", "removed_lines", "base_failed", "kept"}
    kept = [name for name in (docs.columns if keep is None else keep) if name not in own]
    other = [name for name in kept if name != text]  # behind one column, so that no name of theirs meets one of ours
    hosts = F.coalesce(F.col(host).cast("string"), F.lit("\u0000")).alias("host")
    base = docs.select(F.struct(F.lit(0).alias(""), *other).alias("doc"), F.col(text).alias("text"), hosts)
    carried = ["doc", "host", *(["text"] if text in kept else [])]
    texts = materialize(measured(base, "text", carried).withColumn("row_id", F.monotonically_increasing_id()), "measured")
    lines, hot = frequent_lines(texts, limits)
    removed = (
        lines.join(hot, "line_key")
        .groupBy("row_id")
        .agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_set("line")).alias("removed_lines"))
    )
    left = F.col("n_words") - F.col("removed_words")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    depleted = (left < limits.min_words) | (left < F.col("n_words") * limits.keep_share)
    return (
        texts.drop("line_set", "lines", "line_words", "host")
        .join(removed, "row_id", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<long>")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .select(
            *(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in kept),
            *MEASURES.names[:5], "removed_words", "removed_lines", "base_failed", "kept",
        )
    )


def without_lines(docs: DataFrame, text: str = "text", lines: str = "removed_lines") -> DataFrame:
    """``docs`` with the lines named by their hashes cut out of the text; other lines stay as they are."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(lines).to_pylist()
            old = batch.column(text)
            new = old.to_pylist()
            for first, _, data, offsets in blocks(old):
                owner, begin, stop, _, _, normal = word_lines(data, offsets)
                normal = normal.view(np.int64)
                for k in range(len(offsets) - 1):
                    if gone := wanted[first + k]:
                        at = slice(*np.searchsorted(owner, (k, k + 1)))
                        cut = np.isin(normal[at], gone)
                        new[first + k] = _cut(data, offsets[k], offsets[k + 1], begin[at][cut], stop[at][cut])
            columns = [pa.array(new, pa.string()) if name == text else batch.column(name) for name in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _cut(data: np.ndarray, start: int, end: int, begin: np.ndarray, stop: np.ndarray) -> str:
    keep = np.ones(end - start, dtype=bool)
    for a, b in zip(begin - start, stop - start, strict=True):
        keep[a : b + 1] = False  # with its newline
    return data[start:end][keep].tobytes().decode("utf-8")
