"""Spelling variants by composing finite-state machines.

The vocabulary is a minimised acceptor ``A``; ``A o E o A`` with the one-edit transducer ``E`` accepts the pairs of
words that differ by one inserted, deleted or replaced code point. Before its edit both words of a pair
walk through the same states, so the composition falls apart by initial states: the prefixes of the words.

* A prefix with at most ``leaf`` words is one partition: its words' acceptor is built and composed there.
* A prefix with more words is split by its next letter. What its partitions cannot see are the pairs whose edit
  is that very letter; behind it both words must read the same, so these pairs meet by (prefix, what is
  left), a group of at most one word per letter of the alphabet and one without it.

Each pair has one place of edit, behind the longest common prefix, and is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.session import materialize

#: Maximal runs of letters; a run of fewer than ``{least}`` cannot become a word.
RUN = r"([A-Za-z\x{{C0}}-\x{{FF}}]{{{least},}})"
LEAF = 1 << 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """A minimised acyclic acceptor of sorted words: per state its arcs, whether it is final, and the
    shortest and longest word read from it."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.short: list[int] = []
        self.long: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]  # states of the last word, not yet fixed
        last = ""

        def fix(upto: int) -> None:
            while len(path) - 1 > upto:
                arcs, final = path.pop()
                key = (final[0], *arcs.items())
                if key not in known:
                    known[key] = len(self.arcs)
                    self._add(arcs, final[0])
                path[-1][0][last[len(path) - 1]] = known[key]

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            fix(same)
            path.extend(({}, [False]) for _ in word[same:])
            path[-1][1][0] = True
            last = word
        fix(0)
        self.start = len(self.arcs)
        self._add(path[0][0], path[0][1][0])

    def _add(self, arcs: dict[str, int], final: bool) -> None:
        self.arcs.append(arcs)
        self.final.append(final)
        below = arcs.values()
        self.short.append(0 if final else 1 + min((self.short[q] for q in below), default=0))
        self.long.append(max((1 + self.long[q] for q in below), default=0))

    def common(self, a: int, b: int, but: str = "") -> Iterator[str]:
        """Words read from both states, without those that begin with ``but``."""
        todo = [(a, b, "")]
        while todo:
            a, b, read = todo.pop()
            if self.short[a] > self.long[b] or self.short[b] > self.long[a]:
                continue
            if self.final[a] and self.final[b]:
                yield read
            if len(self.arcs[a]) > len(self.arcs[b]):
                a, b = b, a
            other = self.arcs[b]
            todo += [(q, other[c], read + c) for c, q in self.arcs[a].items() if c in other and (read or c != but)]

    def edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of words read from a state whose first letters are the edit."""
        found = []
        arcs = list(self.arcs[state].items())
        for k, (c, a) in enumerate(arcs):
            for d, b in arcs[k + 1 :]:
                found += [(c + x, d + x) for x in self.common(a, b)]
            if len(arcs) > 1 or self.final[state]:  # else the word without c could only begin with c
                found += [(c + x, x) for x in self.common(a, state, c)]
        return found

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Accepted pairs of the composition, each once."""
        edits: dict[int, list[tuple[str, str]]] = {}
        todo = [(self.start, "")]
        while todo:
            state, read = todo.pop()
            if state not in edits:
                edits[state] = self.edits(state)
            for x, y in edits[state]:
                yield read + x, read + y
            todo += [(q, read + c) for c, q in self.arcs[state].items()]


def vocabulary(words: DataFrame, word: str = "word", least: int = 2) -> DataFrame:
    """(word, n): the different words with ``least`` occurrences or more; null is no word."""
    return words.where(F.col(word).isNotNull()).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, n, near, near_n): the words of a vocabulary (word, n) that differ by one code point, both ways round.

    ``word`` is unique and not null. Prefixes with more than ``leaf`` words are split. An empty vocabulary has no pairs.
    """
    spark = words.sparkSession
    inner, edges, size = [], [], 0
    open_ = words.select("word", "n")
    while True:
        prefix = F.substring("word", 1, size)
        counts = open_.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("of"))
        large = materialize(counts.where(F.col("of") > leaf).select("prefix"), "prefixes")
        rows = open_.withColumn("prefix", prefix)
        inner.append(rows.join(large, "prefix", "left_anti"))
        if large.isEmpty():
            break
        split = materialize(rows.join(large, "prefix", "left_semi"), "split")
        edges.append(_edges(split, size))
        open_ = split.where(F.length("word") > size).select("word", "n")
        size += 1
    leaves = inner[0]
    for x in inner[1:]:
        leaves = leaves.unionByName(x)
    total = words.count()
    tasks = max(1, -(-total // leaf))
    leaves = leaves.select("prefix", "word", "n", F.pmod(F.xxhash64("prefix", F.length("prefix")), F.lit(tasks)).alias("task"))
    found = leaves.groupBy("task").applyInArrow(_composed, "word string, n long, near string, near_n long")
    for x in edges:
        found = found.unionByName(x)
    return found


def _edges(rows: DataFrame, size: int) -> DataFrame:
    """Pairs of the words of a split prefix whose edit stands right behind it."""
    rest = F.substring("word", size + 2, 1 << 30)
    letter = F.substring("word", size + 1, 1)
    behind = F.substring("word", size + 1, 1 << 30)
    cut = rows.where(F.length("word") > size).select("prefix", rest.alias("rest"), letter.alias("letter"), "word", "n")
    kept = rows.select("prefix", behind.alias("rest"), F.lit(None).cast("string").alias("letter"), "word", "n")
    member = F.struct("letter", "word", "n")
    met = cut.unionAll(kept).groupBy("prefix", "rest").agg(F.collect_list(member).alias("all")).where(F.size("all") > 1)
    both = met.select("rest", "all", F.explode("all").alias("x")).select("rest", "x", F.explode("all").alias("y"))
    # The word without the letter must not go on with the same letter: that edit has its place further back.
    first = F.substring("rest", 1, 1)
    differ = (F.col("x.letter") != F.col("y.letter")) | (F.col("x.letter").isNull() & (F.col("y.letter") != first)) | (
        F.col("y.letter").isNull() & (F.col("x.letter") != first)
    )
    return both.where(differ).select("x.word", "x.n", F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))


def _composed(table: pa.Table) -> pa.Table:
    """The pairs of each prefix among a task's words."""
    table = table.sort_by([("prefix", "ascending"), ("word", "ascending")])
    prefixes, words, counts = (table.column(c).to_pylist() for c in ("prefix", "word", "n"))
    out: tuple[list, list] = ([], [])
    n = dict(zip(words, counts, strict=True))
    first = 0
    for end in range(1, len(words) + 1):
        if end == len(words) or prefixes[end] != prefixes[first]:
            prefix = prefixes[first]
            if end - first > 1:
                for a, b in Acceptor([w[len(prefix) :] for w in words[first:end]]).pairs():
                    out[0].append(prefix + a)
                    out[1].append(prefix + b)
            first = end
    left, right = out[0] + out[1], out[1] + out[0]
    return pa.table(
        {
            "word": pa.array(left, pa.string()), "n": pa.array([n[w] for w in left], pa.int64()),
            "near": pa.array(right, pa.string()), "near_n": pa.array([n[w] for w in right], pa.int64()),
        }
    )


def spelling_forms(words: DataFrame, ratio: int = 10, leaf: int = LEAF) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a vocabulary (word, n).

    ``n_near`` counts the words one edit away. ``form`` is the most frequent of them (ties: the smallest in code point
    order) if it is ``ratio`` times as frequent as the word, else null like ``form_n``; ``root`` follows forms to the
    last, the word itself if it has none. A form is always more frequent, so forms never run in circles.
    """
    best = near_words(words, leaf).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    rows = words.select("word", "n").join(best, "word", "left")
    often = -F.col("best.minus") >= ratio * F.col("n")
    rows = rows.select(
        "word", F.when(often, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, -F.col("best.minus")).alias("form_n"),
    )
    rows = materialize(rows, "forms")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the way
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            break
        links = materialize(links.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_words(docs: DataFrame, least: int = 7, every: int = 31, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``word``: the lower-cased runs of letters of whole texts, of at least ``least`` code points; a run whose
    ``crc32("<doc_id>:<run>")`` is a multiple of ``every`` has lost the code point at that number modulo its length. A null
    text has none, a null doc_id counts as empty; rows are independent."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN.format(least=least)), F.lit(1))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.expr("substring(run, 1, cast(pmod(h, length(run)) as int))"), F.expr("substring(run, cast(pmod(h, length(run)) as int) + 2)"))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least)


def spelling_variants(docs: DataFrame, least: int = 7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``spelling_forms`` of the words of whole texts that occur twice or more. Repeated rows count as often as they
    occur; an empty table gives no rows; other columns are ignored."""
    words = materialize(vocabulary(document_words(docs, least, text=text, doc_id=doc_id)), "vocabulary")
    return spelling_forms(words)
