"""License passages by diagonal voting.

Every ``k`` neighbouring words of a text are hashed and joined to the places where the templates have the
same words; the words themselves are compared behind the hash. A hit at word ``i`` of a text and word ``j`` of a
template votes for the diagonal ``i - j``, so all hits of one unchanged passage share a diagonal, and
words put in or left out move it by one. Neighbouring diagonals are therefore merged into a span, which is
verified by the share of the template's words that its hits cover and by how closely they stand.

What is found depends on the text alone. Hits are grouped by a digest of the text, in sets of template
places, so copies of a text melt together before the shuffle, and a row holds no more places than the
template has words. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words of texts as they stand; lower-casing A-Z moves no end of a word.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases that count as they stand (label, phrase).
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: The usual notices of public licenses (label, text).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("mit", "spdx license identifier mit"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2", "spdx license identifier apache 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]


@dataclass(frozen=True)
class ScanParams:
    """Hits are ``words`` long. Diagonals at most ``drift`` apart are one span. A span needs ``share`` of its
    template's words, which make up ``dense`` of the words it stretches over; a template of at most ``short`` words, where
    one word more makes another license, needs all on one diagonal. ``block`` words are exploded at once."""

    words: int = 3
    drift: int = 2
    share: float = 0.8
    dense: float = 0.7
    short: int = 16
    block: int = 4096


def license_templates(spark: SparkSession) -> DataFrame:
    """(template, label, exact, text) of ``BASE`` and ``NOTICES``; a table of the same shape may take its place."""
    rows = [(label, True, text) for label, text in BASE] + [(label, False, text) for label, text in NOTICES]
    labels, exact, texts = zip(*rows, strict=True)
    return spark.createDataFrame(
        pa.table({"template": list(range(len(rows))), "label": list(labels), "exact": list(exact), "text": list(texts)})
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _key(gram: str) -> Column:
    """A hash of a run of words. ``lower`` is fast and also merges other letters; A-Z alone counts where words are compared."""
    return F.xxhash64(F.lower(gram))


def _gram(words: str, at: Column, size: int) -> Column:
    return F.concat_ws(" ", *(F.get(words, at + k) for k in range(size)))


def _grams(rows: DataFrame, words: str, size: int, *carried: str) -> DataFrame:
    """``carried`` and, for every run of ``size`` words, its place and text."""
    last = F.size(words) - size
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda at: _gram(words, at, size)))
    return rows.select(*carried, F.posexplode(grams).alias("place", "gram"))


def template_grams(templates: DataFrame, p: ScanParams) -> DataFrame:
    """(key, gram, template, j, label, exact, size): every run of words of every template."""
    rows = templates.select("template", "label", "exact", _words(F.col("text")).alias("words"))
    rows = rows.withColumn("size", F.size("words"))
    return _grams(rows, "words", p.words, "template", "label", "exact", "size").select(
        _key("gram").alias("key"), F.translate("gram", UPPER, LOWER).alias("same"), "template", F.col("place").alias("j"), "label", "exact", "size"
    )


def diagonals(texts: DataFrame, templates: DataFrame, p: ScanParams) -> DataFrame:
    """(of, template, label, exact, size, diagonal, js) from (of, words): the template places voting for each diagonal."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(p.block))
    parts = F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice("words", at + 1, p.block + p.words - 1).alias("words")))
    blocks = texts.select("of", F.explode(parts).alias("part")).select("of", "part.at", "part.words")
    found = _grams(blocks, "words", p.words, "of", "at").withColumn("key", _key("gram"))
    hits = found.join(template_grams(templates, p), "key").where(F.translate("gram", UPPER, LOWER) == F.col("same"))
    return hits.groupBy("of", "template", "label", "exact", "size", (F.col("at") + F.col("place") - F.col("j")).alias("diagonal")).agg(
        F.collect_set("j").alias("js")
    )


def spans(voted: DataFrame, p: ScanParams) -> DataFrame:
    """(of, label, exact, first_word, end_word, coverage): verified spans; an exact or short template needs a whole diagonal."""
    strict = F.col("exact") | (F.col("size") <= p.short)
    order = W.partitionBy("of", "template").orderBy("diagonal")
    apart = strict | (F.col("diagonal") - F.lag("diagonal").over(order) > p.drift)
    merged = voted.withColumn("span", F.sum(F.coalesce(apart, F.lit(True)).cast("long")).over(order))
    hit = merged.select("*", F.explode("js").alias("j"))
    found = hit.groupBy("of", "template", "label", "exact", "size", "span").agg(
        F.collect_set("j").alias("places"),
        F.min(F.col("diagonal") + F.col("j")).alias("first_word"),
        (F.max(F.col("diagonal") + F.col("j")) + p.words).alias("end_word"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda j: F.sequence(j, j + (p.words - 1))))))
    share = covered / F.col("size")
    whole = F.when(strict, share == 1).otherwise(
        (share >= p.share) & (covered >= p.dense * (F.col("end_word") - F.col("first_word")))
    )
    return found.withColumn("coverage", share).where(whole).select("of", "label", "exact", "first_word", "end_word", "coverage")


def license_spans(docs: DataFrame, templates: DataFrame, p: ScanParams = ScanParams(), text: str = "text") -> DataFrame:
    """(of, label, exact, first_word, end_word, coverage) for each different text of ``docs``: ``of`` is its MD5, words
    count from 0, ``end_word`` is one past the span. Texts are read whole; a null text is empty. Templates with fewer
    words than a hit match nothing."""
    texts = docs.select(F.md5(F.coalesce(F.col(text), F.lit(""))).alias("of"), _words(F.col(text)).alias("words"))
    return spans(diagonals(texts, templates, p), p)


ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def license_labels(
    docs: DataFrame, templates: DataFrame, p: ScanParams = ScanParams(), text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default), ``n_words``; ``n_base``, ``first_word`` and ``last_word``: places of
    the exact templates, their smallest and largest start (null without any); ``base_labels`` and ``labels``: labels of
    the exact templates and of all, distinct, sorted, joined by commas (empty without any); ``score``: the best
    share of a template found, 0 if none was verified.

    A null text is empty. Rows are independent and repeated ones get the same result. An empty table gives no rows;
    columns of ``docs`` named like an added one are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    joined = lambda where: F.concat_ws(",", F.array_sort(F.collect_set(F.when(where, F.col("label")))))
    found = license_spans(docs, templates, p, text).groupBy("of").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first_word").cast("long"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first_word").cast("long"))).alias("last_word"),
        joined(F.col("exact")).alias("base_labels"),
        joined(F.lit(True)).alias("labels"),
        F.max("coverage").alias("score"),
    )
    rows = docs.select(
        F.struct(F.lit(0).alias(""), *names).alias("doc"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("of"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("n_words"),
    )
    return rows.join(found, "of", "left").select(
        *(F.col("doc")[c].alias(c) for c in names), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
