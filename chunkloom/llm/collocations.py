"""Collocations by best-first branch-and-bound growth over prefix counts.

Words and two-word phrases are counted first. Two-word phrases are the prefixes that may still grow: a
phrase that extends ``xy`` occurs at most ``f(xy)`` times, so cutting it after ``x`` gives it a score of
at most ``f(xy) / f(x)``. Prefixes are expanded best bound first: a round takes a threshold per language,
expands the prefixes whose bound reaches it, and those that could yet drop a phrase above it, and counts
three-word phrases with these prefixes only. Above the threshold everything is then known; a language
is settled once ``top`` phrases survive there. Ties with the threshold lie above it.

Counting is by chunks of texts whose distinct phrases are combined with numpy before they are added up, so no word
is a hot key. Hashes are counted first; a hash sums up all phrases that share it, so none with enough
occurrences is missed, and those marked are then counted by their words. Marks, of frequent hashes and of a round's
prefixes, reach the tasks as a bit map of fixed size: what collides is counted too, and exactly, so that the
map's size is no limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.llm.text import LOWER, blocks, mix, prefix_hashes, span_hashes, word_spans
from chunkloom.session import materialize

BREAK = np.zeros(256, dtype=bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
STOP = BREAK.copy()
STOP[[0x20, 0x09]] = True
#: Bytes of text cut into phrases at once, hashes held before they are put together, and bits of a map.
CHUNK = 1 << 20
HELD = 1 << 20
BITS = 26
SALTS = 64


@dataclass(frozen=True)
class CollocationParams:
    """Phrases need ``least`` occurrences; the first ``top`` of a language are reported. The first threshold stands at
    ``top * ahead`` two-word phrases, each later one at ``growth`` times as many."""

    least: int = 10
    top: int = 2000
    ahead: int = 2
    growth: int = 4


def grown(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    return mix(hashes * np.uint64(0x9FB21C651E98DF25) + word)


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of the words [starts[i, k], ends[i, k]) of each row i, joined by one space."""
    n, size = starts.shape
    lengths = ends - starts + 1  # each word and the space behind it
    flat = lengths.ravel()
    begin = np.cumsum(flat) - flat
    at = np.arange(int(flat.sum())) + np.repeat(starts.ravel() - begin, flat)
    out = data[np.minimum(at, len(data) - 1)]
    out[begin + flat - 1] = 32
    row = np.append(0, np.cumsum(lengths.sum(axis=1)))
    inside = np.ones(len(out), dtype=bool)
    inside[row[1:] - 1] = False
    offsets = row - np.arange(n + 1)
    return pa.Array.from_buffers(
        pa.large_string(), n, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[inside].tobytes())]
    ).cast(pa.string())


def chunks(texts: pa.Array, langs: pa.Array, sizes: int) -> Iterator[tuple]:
    """Per chunk: languages, each word's language, bytes, starts and ends of words, and for phrases of 1, 2 ... ``sizes``
    words the hash and whether there is one, by first word."""
    coded = langs.dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    seeds = span_seeds(names)
    for first, end, data, offsets in blocks(texts, CHUNK):
        data = LOWER[data]
        starts, ends, bounds = word_spans(data, offsets, STOP)
        if not len(starts):
            continue
        text = np.repeat(np.arange(first, end), np.diff(bounds))
        lang = codes[text]
        words = span_hashes(prefix_hashes(data), starts, ends)
        breaks = np.cumsum(BREAK[data], dtype=np.int32)
        joined = (text[1:] == text[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
        hashes, there = grown(seeds[lang], words), np.ones(len(words), dtype=bool)
        grams = [(hashes, there)]
        for size in range(2, sizes + 1):
            there = there[:-1] & joined[size - 2 :]
            hashes = grown(hashes[:-1], words[size - 1 :])
            grams.append((hashes, there))
        yield names, lang, data, starts, ends, grams


def hash_counts(docs: DataFrame, sizes: int) -> DataFrame:
    """(key, n): how often each hash of phrases of up to ``sizes`` words occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Tally()
        for batch in batches:
            for *_, grams in chunks(batch.column("text"), batch.column("lang"), sizes):
                held.add(np.concatenate([h[ok] for h, ok in grams]))
                if held.size >= HELD:
                    yield from held.flush()
        yield from held.flush()

    counted = docs.select("lang", "text").mapInArrow(count, "key long, n long")
    return counted.groupBy("key").agg(F.sum("n").alias("n"))


class Tally:
    """Hashes with counts, put together before they leave a task."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray) -> None:
        self.parts.append(np.unique(hashes, return_counts=True))
        self.size += len(self.parts[-1][0])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.__init__()
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            sums = np.add.reduceat(counts[order], first) if len(first) else counts
            for k in range(0, len(first), 1 << 16):
                yield pa.record_batch([pa.array(keys[first[k : k + (1 << 16)]].view(np.int64)), pa.array(sums[k : k + (1 << 16)].astype(np.int64))], names=["key", "n"])


def span_seeds(names: pa.Array) -> np.ndarray:
    """A hash per language."""
    raw = [b"lang " + x.encode() for x in names.to_pylist()]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return span_hashes(prefix_hashes(data), ends - [len(x) for x in raw], ends) if raw else np.zeros(0, np.uint64)


def marked(wanted: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - BITS)
    return (wanted[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def phrase_counts(docs: DataFrame, sizes: tuple[int, ...], least: int, wanted: np.ndarray, head: int | None = None) -> DataFrame:
    """(lang, phrase, n) of the phrases of ``sizes`` words that occur ``least`` times or more, and a language's words under
    the phrase ''. Only phrases that are marked in ``wanted`` are counted; with ``head``, those whose first ``head`` words are."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["lang", "phrase", "n"]
        for batch in batches:
            for names, lang, data, starts, ends, grams in chunks(batch.column("text"), batch.column("lang"), max(sizes)):
                at, n = np.unique(lang, return_counts=True)
                yield pa.record_batch([names.take(pa.array(at)), pa.array([""] * len(at)), pa.array(n.astype(np.int64))], names=fields)
                for size in sizes:
                    hashes, there = grams[size - 1]
                    told = grams[(head or size) - 1][0][: len(hashes)]
                    at = np.flatnonzero(there)
                    at = at[marked(shared.value, told[at])]
                    if not len(at):
                        continue
                    _, one, n = np.unique(hashes[at], return_index=True, return_counts=True)
                    at = at[one]
                    words = at[:, None] + np.arange(size)
                    yield pa.record_batch([names.take(pa.array(lang[at])), gathered(data, starts[words], ends[words]), pa.array(n.astype(np.int64))], names=fields)

    counted = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, n long")
    total = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return total.where((F.col("n") >= least) | (F.col("phrase") == ""))


def bit_map(keys: DataFrame) -> np.ndarray:
    """The bits of the hashes ``key``: 2^BITS of them, gathered as 64-bit words, whatever the number of hashes."""
    at = F.shiftrightunsigned("key", 64 - BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - BITS}) & 63L as int))")
    words = keys.groupBy(F.shiftrightunsigned(at, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def prefix_bits(prefixes: DataFrame) -> np.ndarray:
    """The bit map of (lang, phrase) two-word phrases."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, grams in chunks(batch.column("phrase"), batch.column("lang"), 2):
                yield pa.record_batch([pa.array(grams[1][0][grams[1][1]].view(np.int64))], names=["key"])

    return bit_map(prefixes.select("lang", "phrase").mapInArrow(hashes, "key long"))


def _ratio(top: Column, bottom: Column) -> Column:
    """floor(1000000 * top / bottom), exact."""
    return F.call_function("div", (top * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)"), bottom.cast("decimal(38,0)"))


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(15,0)")


def scored(phrases: DataFrame, parts: DataFrame, cuts: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the lowest-scoring of the first ``cuts`` cuts of each phrase."""
    count = lambda name, phrase: parts.select("lang", F.col("phrase").alias(phrase), F.col("n").alias(name))
    rows = phrases.select("lang", "phrase", F.col("n").alias("a"))
    for k in range(1, cuts + 1):
        first = F.substring_index("phrase", " ", k)
        rows = rows.withColumns({f"first{k}": first, f"rest{k}": F.expr(f"substring(phrase, length(substring_index(phrase, ' ', {k})) + 2)")})
        rows = rows.join(count(f"l{k}", f"first{k}"), ["lang", f"first{k}"]).join(count(f"r{k}", f"rest{k}"), ["lang", f"rest{k}"])
    square = (_wide("a") * _wide("a")).cast("decimal(30,0)")
    made = [F.struct(_ratio(square, _wide(f"l{k}") * _wide(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, cuts + 1)]
    best = F.least(*made) if cuts > 1 else made[0]
    return rows.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def first_rows(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each language with their ``rank``; cut per salt before a language meets in one task."""
    for keys in (["lang", "salt"], ["lang"]):
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= n)
    return rows.drop("salt")


def _best() -> list[Column]:
    return [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]


def collocations(docs: DataFrame, p: CollocationParams = CollocationParams(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``p.top`` phrases of two or three words.

    A phrase occurs ``a`` times within pieces of texts (between marks and line ends), its parts at the lowest-scoring
    cut ``l`` and ``r`` times, the language has ``n`` words; ``score`` is floor(10^6 a a / (l r)). Phrases inside a longer
    one with half of their occurrences are left out. Ties go by more occurrences, then by phrase in byte order. A null
    language is ``und``, a null text empty; repeated rows count as often as they occur. An empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    often = bit_map(hash_counts(rows, 2).where(F.col("n") >= p.least))
    small = materialize(phrase_counts(rows, (1, 2), p.least, often), "phrases")
    words = small.where("phrase = ''").select("lang", F.col("n").alias("words"))
    pairs = scored(small.where("phrase like '% %'"), small, 1)
    # What begins with the pair has a score of at most floor(10^6 a / l) and at most a occurrences.
    pairs = materialize(pairs.withColumn("bound", _ratio(_wide("a"), _wide("l"))), "pairs")
    none = docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, score long")
    triples, expanded, settled = none, none.select("lang", "phrase"), none.withColumn("rank", F.lit(0).cast("long"))
    reach = p.top * p.ahead
    while not pairs.isEmpty():
        # A language's threshold; without one (it has fewer pairs) everything lies above it.
        limit = first_rows(pairs, reach, *_best()).where(F.col("rank") == reach)
        limit = materialize(limit.select("lang", F.col("score").alias("least_score"), F.col("a").alias("least_a")), "limit")
        limited = pairs.join(limit, "lang", "left")
        high = limited.where(_above("score"))
        # Prefixes wx that could make a wxy with half the occurrences of a high xy.
        half = high.groupBy("lang", _head(1).alias("word")).agg(F.min("a").alias("half"))
        before = pairs.select("lang", "phrase", "a", _tail(1).alias("word")).join(half, ["lang", "word"]).where("2 * a >= half")
        fresh = limited.where(_above("bound")).select("lang", "phrase").unionAll(before.select("lang", "phrase")).distinct()
        fresh = materialize(fresh.join(expanded, ["lang", "phrase"], "left_anti"), "frontier")
        expanded = expanded.unionAll(fresh)
        more = scored(phrase_counts(rows, (3,), p.least, prefix_bits(fresh), head=2).where("phrase <> ''"), small, 2)
        triples = materialize(triples.unionAll(more).distinct(), "triples")  # a collision may count a triple twice
        inside = triples.select("lang", _head(2).alias("phrase"), "a").unionAll(triples.select("lang", _tail(2).alias("phrase"), "a"))
        inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        alive = pairs.join(inside, ["lang", "phrase"], "left").where("longer is null or 2 * longer < a").select(*none.columns)
        known = triples.unionAll(alive).join(limit, "lang", "left").where(_above("score")).select(*none.columns)
        best = materialize(first_rows(known, p.top, *_best()), "best")
        found = best.groupBy("lang").agg(F.count("*").alias("found"))
        # A language that is not settled has a threshold and too few phrases above it.
        open_ = materialize(limit.join(found, "lang", "left").where(F.coalesce("found", F.lit(0)) < p.top).select("lang"), "open")
        settled = settled.unionByName(best.join(open_, "lang", "left_anti"))
        pairs, triples = (x.join(open_, "lang", "left_semi") for x in (pairs, triples))
        reach *= p.growth
    out = settled.join(words, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def _head(n: int) -> Column:
    return F.substring_index("phrase", " ", n)


def _tail(n: int) -> Column:
    return F.substring_index("phrase", " ", -n)


def _above(score: str) -> Column:
    """Whether (score, occurrences) reaches the threshold, if there is one."""
    ties = (F.col(score) == F.col("least_score")) & (F.col("a") >= F.col("least_a"))
    return F.col("least_a").isNull() | (F.col(score) > F.col("least_score")) | ties


COLLOCATION_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, z[1] || ' ' || z[2] FROM (
    SELECT lang, unnest(list_zip(ws[:-2], ws[2:])) AS z FROM w WHERE len(ws) > 1)
  UNION ALL SELECT lang, 3, z[1] || ' ' || z[2] || ' ' || z[3] FROM (
    SELECT lang, unnest(list_zip(ws[:-3], ws[2:-2], ws[3:])) AS z FROM w WHERE len(ws) > 2)),
g AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, ws[1] AS first, array_to_string(ws[2:], ' ') AS rest FROM c
  UNION ALL SELECT lang, phrase, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM c WHERE k = 3),
s AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN g AS x ON x.lang = cuts.lang AND x.phrase = first JOIN g AS y ON y.lang = cuts.lang AND y.phrase = rest
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM c WHERE k = 3) GROUP BY ALL),
r AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
