"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, shuffled by a hash, form a stream of words that repeats ``repeats`` times
at most and is cut into blocks of ``block`` words. The mix has a slot per block. Slot ``i`` is the
golden-ratio point ``frac(i * g)``; laid onto the cumulative target shares it names a source, and
its rank among that source's slots names the block. The last slots are set right by the source's target: blocks
beyond it are given back, missing ones follow, and the last block holds what remains, so that every source
has its target to the word, however small it is. A document's words in the mix are those of its places in the
stream that lie in such blocks.

Ranks and stream offsets are sums of totals of bounded segments and a running count inside one
segment, so that a source with a third of all rows is never one window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.llm.salt import join_groups
from chunkloom.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: The golden ratio's fraction of 2^32, and the cells by which points meet the sources' shares.
GOLDEN = 2654435769
CELLS = 1 << 14
SLOTS, ROWS = 1 << 16, 20_000


@dataclass(frozen=True)
class MixParams:
    """``weights`` repeat over the sources in code point order, null last; the mix has ``share`` of all words, in blocks of ``block``."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    repeats: int = 3
    block: int = 128


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, p: MixParams) -> DataFrame:
    """(source, source_size) and ``rank``, ``target``: shares by weight, filled up to ``repeats`` sizes.

    In the order of size by weight, a source is full if its part of what the sources before it leave is
    above its limit; the first that is not full sets the level of all later ones.
    """
    chosen = F.element_at(F.array(*map(F.lit, p.weights)), (F.pmod(F.col("rank"), F.lit(len(p.weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1)
        .withColumn("weight", chosen.cast("double"))
        .withColumn("most", (p.repeats * F.col("source_size")).cast("double"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("mix", F.sum("source_size").over(W.partitionBy()) * F.lit(p.share))
    )
    by = W.orderBy("ratio", "rank")
    level = (F.col("mix") - F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(by.rowsBetween(0, W.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))).over(W.partitionBy())["level"]
    )
    target = F.least("most", F.coalesce(F.col("weight") * F.col("level"), F.col("most")))
    return filled.select("source", "source_size", "rank", target.alias("target"))


def _before(total: DataFrame, key: str, segment: str, amount: str) -> DataFrame:
    """Per (key, segment) the sum of ``amount`` in the segments before it."""
    ahead = W.partitionBy(key).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    return total.select(key, segment, F.coalesce(F.sum(amount).over(ahead), F.lit(0)).alias("before"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(rank, block): the blocks that the mix takes, block ``k`` of a source from its ``k``-th slot."""
    spark = sources.sparkSession
    low, high = F.floor(F.col("id") / 65536), F.pmod("id", F.lit(65536))
    low = F.pmod(F.pmod(low, F.lit(65536)) * GOLDEN, F.lit(65536))
    points = spark.range(slots).select("id", (F.pmod(low * 65536 + high * GOLDEN, F.lit(1 << 32)) / (1 << 32)).alias("point"))
    by = W.orderBy("rank")
    whole = F.sum("target").over(W.partitionBy())
    upto = F.sum("target").over(by.rowsBetween(W.unboundedPreceding, 0)) / whole
    last = F.lead("rank").over(by).isNull()
    spans = (
        sources.where("target > 0")
        .select("rank", F.when(last, F.lit(2.0)).otherwise(upto).alias("till"))
        .withColumn("from", F.coalesce(F.lag("till").over(by), F.lit(0.0)))
    )
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("from")), cell(F.col("till")))))
    dealt = (
        points.withColumn("cell", cell(F.col("point")))
        .join(spans, "cell")
        .where("point >= from and point < till")
        .select("id", "rank", F.floor(F.col("id") / SLOTS).alias("segment"))
    )
    before = _before(dealt.groupBy("rank", "segment").agg(F.count("*").alias("n")), "rank", "segment", "n")
    inside = F.row_number().over(W.partitionBy("rank", "segment").orderBy("id")) - 1
    return dealt.withColumn("inside", inside).join(before, ["rank", "segment"]).select("rank", (F.col("before") + F.col("inside")).alias("block"))


def settled(slots: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """(rank, block, words): the schedule's blocks, with each source's end set right to its target in whole words."""
    whole = F.round("target").cast("long")
    needed = sources.select("rank", whole.alias("whole")).where("whole > 0").withColumn("needed", F.ceil(F.col("whole") / block))
    dealt = slots.groupBy("rank").agg((F.max("block") + 1).alias("dealt"))
    known = needed.join(dealt, "rank", "left").withColumn("dealt", F.coalesce("dealt", F.lit(0)))
    # The points' discrepancy bounds what is missing: it grows as the logarithm of the slots.
    missing = known.where("dealt < needed").withColumn("block", F.explode(F.sequence(F.col("dealt"), F.col("needed") - 1)))
    kept = slots.join(needed, "rank").where("block < needed").select("rank", "block", "whole").unionAll(missing.select("rank", "block", "whole"))
    return kept.select("rank", "block", F.least(F.lit(block), F.col("whole") - F.col("block") * block).alias("words"))


def mixture(
    docs: DataFrame,
    p: MixParams = MixParams(),
    text: str = "text",
    doc_id: str = "doc_id",
    source: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken`` counts a document's words in the mix, repeats included: ``taken div size`` whole copies
    and then its first ``taken % size`` words. A source's ``taken`` add up to its target, rounded. A null text has no words and is never taken; a null
    source is a source of its own. The shuffle hashes doc_id and text, so reruns agree; rows that
    repeat are rows of their own. A table without words has targets of 0. Columns of ``docs`` named
    like an added one are replaced.
    """
    added = {"size", "source_size", "target", "taken"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    base = docs.select(
        F.struct(*names).alias("doc"),
        F.col(source).cast("string").alias("source"),
        n_words(text).alias("size"),
        F.xxhash64(doc_id, text).alias("key"),
        F.monotonically_increasing_id().alias("row"),
    )
    base = materialize(base, "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = materialize(sizes, "sources")
    words, rows = sizes.agg(F.sum("source_size"), F.sum("docs")).first()
    sources = materialize(targets(sizes.select("source", "source_size"), p), "targets")

    parts = max(1, -(-(rows or 0) // ROWS))
    unit = F.col("key") / F.lit(2.0**64) + F.lit(0.5)
    told = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("of")  # a join takes no null
    placed = (
        join_groups(base.select("row", "key", "size", told), sources.select(told, "rank", "source_size", "target"), "of", "row")
        .select("row", "key", "size", "rank", "source_size", "target", F.floor(unit * parts).alias("segment"))
    )
    before = _before(placed.groupBy("rank", "segment").agg(F.sum("size").alias("n")), "rank", "segment", "n")
    running = W.partitionBy("rank", "segment").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(running), F.lit(0))
    streams = (
        placed.withColumn("inside", inside)
        .join(before, ["rank", "segment"])
        .select("row", "rank", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("start"))
    )
    slots = materialize(schedule(sources, round((words or 0) * p.share / p.block)), "slots")
    taken = _taken(materialize(streams, "streams"), settled(slots, sources, p.block), p)
    return base.select("doc", "row", "size").join(taken, "row").select("doc.*", "size", "source_size", "target", "taken")


def _taken(streams: DataFrame, slots: DataFrame, p: MixParams) -> DataFrame:
    """(row, source_size, target, taken) by the join of the places in the streams with the slots' blocks."""
    copies = F.ceil(F.round("target") / F.col("source_size"))  # of the stream, that the source's words reach
    start, end, cut = F.col("begin"), F.col("begin") + F.col("size"), F.col("block") * p.block
    places = (
        streams.where("size > 0 and round(target) > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
        .select("rank", "start", "size", (F.col("copy") * F.col("source_size") + F.col("start")).alias("begin"))
        .withColumn("block", F.explode(F.sequence(F.floor(start / p.block), F.floor((end - 1) / p.block))))
        .select("rank", "start", "block", (F.greatest(start, cut) - cut).alias("first"), (F.least(end, cut + p.block) - cut).alias("end"))
    )
    inside = F.greatest(F.least("end", "words") - F.col("first"), F.lit(0))
    taken = places.join(slots, ["rank", "block"]).groupBy("rank", "start").agg(F.sum(inside).alias("taken"))
    counted = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(0).cast("long")
    return streams.join(taken, ["rank", "start"], "left").select("row", "source_size", "target", counted.alias("taken"))


def mixed(counted: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: a row per whole copy of a document, and one with its first words for the rest."""
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    words = F.filter(F.split(F.col(text), GAP), lambda w: w != "")
    copies = F.when(F.col("taken") > 0, F.sequence(F.lit(1), F.expr("cast(ceil(taken / size) as int)"))).otherwise(
        F.array().cast("array<int>")
    )
    start = F.concat_ws(" ", F.slice(words, F.lit(1), rest.cast("int")))
    return counted.withColumn("mix_copy", F.explode(copies)).withColumn(
        text, F.when(F.col("mix_copy") <= whole, F.col(text)).otherwise(start)
    ).drop("mix_copy")
