"""Rule matching and rule texts.

A rule may match a large share of all symbols. Its list of names is therefore kept in
parts, one per file and line segment, which read in order give the whole text. Only a
request's result, bounded by its limits, is joined into one text per rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.patterns import any_regex, glob_match
from chunkloom.functions.text import html_escape
from chunkloom.operators.segments import line_segment
from chunkloom.session import materialize
from chunkloom.sources.rules import Rule, Ruleset


def matches(rule: Rule) -> Column:
    """Whether a symbol fits the rule: all four parts, each by any of its patterns."""
    return (
        any_regex(F.col("kind"), rule.kind)
        & any_regex(F.col("name"), rule.name)
        & glob_match(F.col("path"), rule.path)
        & any_regex(F.col("code"), rule.code)
    )


def match_rules(symbols: DataFrame, ruleset: Ruleset) -> DataFrame:
    """One row per matching symbol and rule, with ``rule_pos``.

    The rules are literals of one projection: patterns are compiled once and only matches
    are emitted. A rule with an empty pattern list and a symbol without code never match.
    """
    flags = [F.when(matches(rule), F.lit(pos)) for pos, rule in enumerate(ruleset.depends_on)]
    positions = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<int>")
    return symbols.withColumn("rule_pos", F.explode(positions))


def symbols_by_rule(matched: DataFrame) -> DataFrame:
    """Matched symbols listed per rule, file and line segment, in order of start line."""
    return (
        matched.withColumn("segment", line_segment(F.col("start_line")))
        .groupBy("rule_pos", "path", "segment")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("start_line", "symbol_id", "name"))),
                lambda s: s["name"],
            ).alias("names")
        )
    )


_LOOP = re.compile(
    r"\{%-?\s*for\s+(\w+)\s+in\s+symbols\s*-?%\}(.*?)\{%-?\s*endfor\s*-?%\}|\{(symbols)(?:\.(\w+))?\}", re.S
)
_LAST = re.compile(r"\{%-?\s*if\s+not\s+loop\.last\s*-?%\}(.*?)\{%-?\s*endif\s*-?%\}", re.S)
_FIELDS = ("name", "kind", "path", "code", "container_name", "hover")


def template_pieces(template: str) -> list[tuple]:
    """Pieces of a rule template: ``("text", s)`` or ``("each", parts, separator, tail)``.

    A loop over ``symbols`` may print fields of its variable and one separator under "not
    loop.last"; ``{symbols}`` and ``{symbols.field}`` are short for a comma-joined list. In
    ``parts`` a one-element tuple is a field, a string is literal text.
    """
    pieces: list[tuple] = []
    at = 0
    for found in _LOOP.finditer(template):
        if found.start() > at:
            pieces.append(("text", template[at : found.start()]))
        at = found.end()
        if found.group(3):
            pieces.append(("each", [(found.group(4) or "name",)], ", ", ""))
            continue
        variable, body = found.group(1), found.group(2)
        last = _LAST.search(body)
        separator, tail = (last.group(1), body[last.end() :]) if last else ("", "")
        head = body[: last.start()] if last else body
        printed = re.split(r"\{\{\s*" + variable + r"\.(\w+)\s*\}\}", head)
        parts = [p if i % 2 == 0 else (p,) for i, p in enumerate(printed) if p or i % 2]
        pieces.append(("each", parts, separator, tail))
    if at < len(template):
        pieces.append(("text", template[at:]))
    for piece in pieces:
        literal = piece[1] if piece[0] == "text" else "".join(p for p in piece[1] if isinstance(p, str)) + piece[3]
        if "{%" in literal or "{{" in literal:
            raise ValueError(f"unsupported template syntax in {literal!r}")
        if piece[0] == "each":
            unknown = [p[0] for p in piece[1] if isinstance(p, tuple) and p[0] not in _FIELDS]
            if unknown:
                raise ValueError(f"unknown symbol fields {unknown}")
    return pieces


def _printed_fields(template: str) -> list[tuple[str]]:
    return [p for piece in template_pieces(template) if piece[0] == "each" for p in piece[1] if isinstance(p, tuple)]


def _segment_text(piece: tuple) -> Column:
    """Text of one list piece over a sorted array of symbol structs."""
    _, parts, separator, tail = piece

    def item(symbol: Column) -> Column:
        printed = [
            F.lit(p) if isinstance(p, str) else F.coalesce(html_escape(symbol[p[0]]), F.lit("")) for p in parts
        ]
        return F.concat(*printed)

    return F.array_join(F.transform("symbols", item), separator + tail)


def rule_text_parts(matched: DataFrame, ruleset: Ruleset) -> DataFrame:
    """Rendered texts of the rules that match a symbol, in parts.

    The lists are read twice, for their ends and for their texts, so they are written to
    the shared folder first rather than matched twice.

    Columns ``rule_pos, template_pos, piece, path, segment, text``. Joined in the order of
    the first five the texts of one ``(rule_pos, template_pos)`` are the rule's whole text.
    Literal pieces have an empty path and segment 0.
    """
    printed = {p[0] for r in ruleset.depends_on for t in r.rules for p in _printed_fields(t)}
    fields = [c for c in _FIELDS if c in printed]
    lists = materialize(
        matched.withColumn("segment", line_segment(F.col("start_line")))
        .groupBy("rule_pos", "path", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("start_line", "symbol_id", *fields))).alias("symbols")),
        "rule-lists",
    )
    # One row per rule of the file, at most.
    edges = lists.groupBy("rule_pos").agg(
        F.min(F.struct("path", "segment")).alias("first"), F.max(F.struct("path", "segment")).alias("last")
    )
    marked = lists.join(F.broadcast(edges), "rule_pos")
    here = F.struct("path", "segment")
    is_first, is_last = here == F.col("first"), here == F.col("last")

    def rows(pos: int, rule: Rule) -> Column:
        out = []
        for number, template in enumerate(rule.rules):
            for order, piece in enumerate(template_pieces(template)):
                each = piece[0] == "each"
                if each:
                    text = F.concat(
                        F.when(is_first, F.lit("")).otherwise(F.lit(piece[2] + piece[3])),
                        _segment_text(piece),
                        F.when(is_last, F.lit(piece[3])).otherwise(F.lit("")),
                    )
                else:
                    text = F.lit(piece[1])
                row = F.struct(
                    F.lit(number).alias("template_pos"),
                    F.lit(order).alias("piece"),
                    (F.col("path") if each else F.lit("")).alias("path"),
                    (F.col("segment") if each else F.lit(0).cast("long")).alias("segment"),
                    text.alias("text"),
                )
                # A literal piece is emitted once, with the rule's first segment.
                out.append(row if each else F.when(is_first, row))
        return F.array_compact(F.array(*out))

    shape = "array<struct<template_pos:int,piece:int,path:string,segment:bigint,text:string>>"
    texts = F.array().cast(shape)
    for pos, rule in enumerate(ruleset.depends_on):
        if rule.rules:
            texts = F.when(F.col("rule_pos") == pos, rows(pos, rule).cast(shape)).otherwise(texts)
    return marked.select("rule_pos", F.inline(texts))


def rules_for_request(symbols: DataFrame, ruleset: Ruleset) -> DataFrame:
    """``(position, text)`` of a request's rules: the common ones, then the matched ones.

    For the symbols of one search, whose number is bounded by the request's limits: each
    rule's parts are joined into one text here.
    """
    spark = symbols.sparkSession
    parts = rule_text_parts(match_rules(symbols, ruleset), ruleset)
    whole = parts.groupBy("rule_pos", "template_pos").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("piece", "path", "segment", "text"))), lambda p: p["text"]
            ),
            "",
        ).alias("text")
    )
    # Positions: common texts first, then by rule and template.
    offsets, at = [], len(ruleset.common)
    for rule in ruleset.depends_on:
        offsets.append(at)
        at += len(rule.rules)
    starts = F.array(*[F.lit(o) for o in offsets]) if offsets else F.array().cast("array<int>")
    matched = whole.select((F.get(starts, F.col("rule_pos")) + F.col("template_pos")).alias("position"), "text")
    common = spark.createDataFrame(list(enumerate(ruleset.common)), "position int, text string")
    return common.unionByName(matched)
