"""Symbols: extraction, normalisation, as-of and range lookups, source code, hover."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.functions.kinds import kind_name
from chunkloom.functions.patterns import any_regex
from chunkloom.functions.paths import uri_to_path
from chunkloom.functions.text import hover_text
from chunkloom.operators.segments import SEGMENT_LINES, carried, line_segment, number_rows


def extract_symbols(docs: DataFrame, patterns: Sequence[tuple[Column | str, str]]) -> DataFrame:
    """Symbols of documents with ``lines``; the other columns are kept.

    ``patterns`` holds ``(kind, regex)`` pairs; the regex's first group is the name and the
    kind is a name or a column over ``name``. The first pattern that fits a line wins. A
    symbol reaches up to the line before the next symbol, or to the end of its file. Array
    functions inside the row: no shuffle.
    """

    def match(line: Column) -> Column:
        return F.coalesce(
            *[
                F.when(
                    F.regexp_extract(line, regex, 1) != "",
                    F.struct(F.regexp_extract(line, regex, 1).alias("name"), F.lit(i).alias("rule")),
                )
                for i, (_, regex) in enumerate(patterns)
            ]
        )

    found = F.filter(
        F.transform("lines", lambda line, i: F.struct(i.alias("at"), line.alias("line"), match(line).alias("found"))),
        lambda x: x["found"].isNotNull(),
    )
    keep = [c for c in docs.columns if c not in ("lines", "name", "kind")]
    listed = docs.select(*keep, F.size("lines").alias("__n"), found.alias("__found"))
    ended = F.transform(
        "__found",
        lambda x, i: F.struct(
            x["at"].alias("at"), x["line"].alias("line"), x["found"].alias("found"),
            (F.coalesce(F.get("__found", i + 1)["at"], F.col("__n")) - 1).alias("end"),
        ),
    )
    rows = listed.select(*keep, F.explode(ended).alias("__s")).withColumn("name", F.col("__s.found.name"))
    kind = F.coalesce(
        *[
            F.when(F.col("__s.found.rule") == i, F.lit(k) if isinstance(k, str) else k)
            for i, (k, _) in enumerate(patterns)
        ]
    )
    place = F.instr("__s.line", F.col("name")) - 1
    return rows.select(
        *keep,
        "name",
        kind.alias("kind"),
        F.col("__s.at").cast("long").alias("start_line"),
        F.col("__s.end").cast("long").alias("end_line"),
        place.cast("long").alias("start_character"),
        (place + F.length("name")).cast("long").alias("end_character"),
    )


def filter_kinds(symbols: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Keep symbols whose kind matches any regex; no regex at all means no filter."""
    return symbols.filter(any_regex(F.col("kind"), kinds)) if kinds else symbols


def split_rejects(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass ``ok`` and rows that do not, a null counting as a failure."""
    passed = F.coalesce(ok, F.lit(False))
    return df.filter(passed), df.filter(~passed)


def normalize_symbols(flat: DataFrame, nested: DataFrame) -> DataFrame:
    """One row shape from flat and nested symbol answers.

    ``flat``: ``(symbol_id, name, kind_code, uri, range, container_name)``, a null range
    becoming (0,0)-(0,0). ``nested``: ``(symbol_id, name, kind_code, document_uri, range,
    selection_range)``; the position of the name is the end of the selection, and children
    are not flattened. Ranges are ``struct<start: struct<line, character>, end: ...>``.
    """
    position = "struct<line: bigint, character: bigint>"
    none = F.lit(None)
    one = flat.select(
        "symbol_id",
        "name",
        kind_name(F.col("kind_code")).alias("kind"),
        F.col("uri"),
        "range",
        "container_name",
        none.cast(position).alias("name_position"),
    )
    two = nested.select(
        "symbol_id",
        "name",
        kind_name(F.col("kind_code")).alias("kind"),
        F.col("document_uri").alias("uri"),
        "range",
        none.cast("string").alias("container_name"),
        F.col("selection_range.end").cast(position).alias("name_position"),
    )
    rows = one.unionByName(two)

    def at(edge: str, part: str) -> Column:
        return F.coalesce(F.col(f"range.{edge}.{part}").cast("long"), F.lit(0).cast("long"))

    return rows.select(
        "symbol_id",
        "name",
        "kind",
        "uri",
        uri_to_path(F.col("uri")).alias("path"),
        at("start", "line").alias("start_line"),
        at("start", "character").alias("start_character"),
        at("end", "line").alias("end_line"),
        at("end", "character").alias("end_character"),
        "container_name",
        "name_position",
    )


def of_paths(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the files that ``wanted`` names: the symbols of the documents that have a hit,
    or the documents that a few symbols lie in. If the wanted paths are few, the rows are
    filtered where they are read."""
    return rows.join(wanted.select("path").distinct(), "path", "left_semi")


def of_few_paths(rows: DataFrame, wanted: DataFrame, few: int = 1000) -> DataFrame:
    """``of_paths`` for a request's result: the paths, which its limits bound, become a filter of the scan, so that
    a table clustered by path reads the row groups that hold them. More than ``few`` are met by a join
    within their range. Runs a job over ``wanted``."""
    names = wanted.select("path").distinct()
    found = [r.path for r in names.limit(few + 1).collect()]
    if len(found) <= few:
        return rows.filter(F.col("path").isin(found))
    first, last = names.agg(F.min("path"), F.max("path")).first()
    return of_paths(rows.filter(F.col("path").between(first, last)), names)


def next_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that directly follow a chunk when both are ordered by start line per file.

    A chunk comes before a symbol on the same line. Several chunks in a row give their
    next symbol once. ``symbols`` needs ``path, start_line, symbol_id``.
    """
    marks = chunks.select("path", "start_line").distinct()
    pointers = (
        marks.withColumn("is_symbol", F.lit(0))
        .withColumn("symbol_id", F.lit(-1).cast(symbols.schema["symbol_id"].dataType))
        .unionByName(symbols.withColumn("is_symbol", F.lit(1)), allowMissingColumns=True)
        .withColumn("segment", line_segment(F.col("start_line")))
    )
    order = W.partitionBy("path", "segment").orderBy("start_line", "is_symbol", "symbol_id")
    near = pointers.withColumn("before", F.lag("is_symbol").over(order))
    # A symbol that opens its segment follows whatever the earlier segments end with.
    likely = near.filter((F.col("is_symbol") == 1) & (F.coalesce("before", F.lit(0)) == 0))
    end = (F.max(F.col("start_line") * 2 + F.col("is_symbol")) % 2).cast("int")
    return (
        likely.join(carried(pointers, ["path"], "segment", end), ["path", "segment"], "left")
        .filter(F.coalesce("before", "carried") == 0)
        .select(*symbols.columns)
    )


def enclosing_symbols(chunks: DataFrame, symbols: DataFrame, bucket: int = 64) -> DataFrame:
    """The symbols whose line range overlaps a chunk of their file, each once.

    Chunk ends are exclusive, symbol ends inclusive. Both sides are exploded to line
    buckets so that the join is an equi-join with a residual range condition.
    """

    def buckets(first: Column, last: Column) -> Column:
        return F.explode(
            F.sequence(F.floor(first / bucket), F.greatest(F.floor(last / bucket), F.floor(first / bucket)))
        )

    spans = chunks.select(
        "path",
        F.col("start_line").alias("c_start"),
        F.col("end_line").alias("c_end"),
        buckets(F.col("start_line"), F.col("end_line") - 1).alias("bucket"),
    ).distinct()
    ranged = symbols.withColumn("bucket", buckets(F.col("start_line"), F.col("end_line")))
    cond = (
        (ranged["path"] == spans["path"])
        & (ranged["bucket"] == spans["bucket"])
        & (ranged["start_line"] < spans["c_end"])
        & (ranged["end_line"] >= spans["c_start"])
    )
    return ranged.join(spans, cond, "left_semi").drop("bucket").dropDuplicates(["path", "start_line", "symbol_id"])


def attach_code(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Add ``code`` and ``name_line``/``name_character`` from the documents' ``lines``.

    ``code`` is every line from start to end, both inclusive, so nested symbols get theirs
    in full. The name position is the first line of that range that holds the name, at the
    last character of its first occurrence; a position the symbol already has is kept. A
    symbol without a document keeps nulls. One equi-join on the path and slices of the line
    array: no range join. A path with many symbols is split by AQE's skew join.
    """
    joined = symbols.join(docs.select("path", "lines"), "path", "left")
    first = F.col("start_line").cast("int")
    height = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int")
    body = F.slice("lines", first + 1, height)
    joined = joined.withColumn("__body", body)
    holds = F.filter(
        F.transform(
            "__body",
            lambda line, i: F.struct(
                (F.col("start_line") + i).cast("long").alias("line"),
                F.position(F.col("name"), line).alias("at"),
            ),
        ),
        lambda hit: (hit["at"] > 0) & (F.length("name") > 0),
    )
    spot = F.get(holds, F.lit(0))
    have = {"name_line", "name_character"} <= set(symbols.columns)
    line = spot["line"]
    char = (spot["at"] + F.length("name") - 2).cast("long")
    if have:
        known = F.col("name_line").isNotNull()
        line = F.when(known, F.col("name_line")).otherwise(line)
        char = F.when(known, F.col("name_character")).otherwise(char)
    keep = [c for c in symbols.columns if c not in ("code", "name_line", "name_character")]
    return joined.select(
        *keep,
        F.array_join("__body", "\n").alias("code"),
        line.alias("name_line"),
        char.alias("name_character"),
    )


def line_segments(lines: DataFrame) -> DataFrame:
    """``path, segment, lines`` from rows ``path, line_no, line``: documents of any length as rows of up to
    ``SEGMENT_LINES`` lines, for files that are too long for one row. Line numbers of a file have no gaps."""
    numbered = lines.select("path", F.col("line_no").cast("long").alias("line_no"), "line")
    listed = numbered.groupBy("path", line_segment(F.col("line_no")).alias("segment")).agg(F.collect_list(F.struct("line_no", "line")).alias("l"))
    return listed.select("path", "segment", F.transform(F.array_sort("l"), lambda x: x["line"]).alias("lines"))


def attach_code_segments(symbols: DataFrame, segments: DataFrame) -> DataFrame:
    """``attach_code`` over ``line_segments``: the same columns, and no row holds a whole file.

    A symbol meets the segments that its lines reach into by an equi-join, each gives its part of the code and its first
    line with the name, and the least of these is the name's. ``symbol_id`` is unique.
    """
    first, last = line_segment(F.col("start_line")), line_segment(F.greatest("start_line", "end_line"))
    asked = symbols.select("symbol_id", "path", "name", "start_line", "end_line", F.explode(F.sequence(first, last)).alias("segment"))
    met = asked.join(segments.select("path", "segment", "lines"), ["path", "segment"])
    base = F.col("segment") * SEGMENT_LINES
    begin = F.greatest(F.col("start_line") - base, F.lit(0))
    height = F.greatest(F.least(F.col("end_line") - base + 1, F.size("lines")) - begin, F.lit(0))
    body = F.slice("lines", begin.cast("int") + 1, height.cast("int"))
    met = met.select("symbol_id", "name", "segment", (base + begin).alias("from"), body.alias("body"))
    holds = F.filter(
        F.transform("body", lambda line, i: F.struct((F.col("from") + i).alias("line"), F.position(F.col("name"), line).alias("at"))),
        lambda hit: (hit["at"] > 0) & (F.length("name") > 0),
    )
    part = F.when(F.size("body") > 0, F.struct("segment", F.array_join("body", "\n").alias("text")))
    found = met.groupBy("symbol_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n").alias("code"),
        F.min(F.get(holds, F.lit(0))).alias("spot"),
    )
    keep = [c for c in symbols.columns if c not in ("code", "name_line", "name_character")]
    have = {"name_line", "name_character"} <= set(symbols.columns)
    joined = symbols.join(found.withColumnRenamed("code", "__code"), "symbol_id", "left")
    line, char = F.col("spot.line"), (F.col("spot.at") + F.length("name") - 2).cast("long")
    if have:
        known = F.col("name_line").isNotNull()
        line, char = F.when(known, F.col("name_line")).otherwise(line), F.when(known, F.col("name_character")).otherwise(char)
    return joined.select(*keep, F.col("__code").alias("code"), line.alias("name_line"), char.alias("name_character"))


def attach_hover(symbols: DataFrame, hovers: DataFrame) -> DataFrame:
    """Add ``hover`` by the place of the symbol's name; symbols without one keep a null.

    ``hovers``: ``(path, line, character, hover)`` with the struct of ``hover_text``.
    """
    texts = hovers.select(
        "path",
        F.col("line").alias("name_line"),
        F.col("character").alias("name_character"),
        hover_text(F.col("hover")).alias("hover"),
    )
    return symbols.drop("hover").join(texts, ["path", "name_line", "name_character"], "left")


def group_by_path(symbols: DataFrame) -> DataFrame:
    """Symbols listed per file and line segment, in order of start line.

    Segments bound the list; a file of up to ``SEGMENT_LINES`` lines is one row.
    """
    return (
        symbols.withColumn("segment", line_segment(F.col("start_line")))
        .groupBy("path", "segment")
        .agg(F.array_sort(F.collect_list(F.struct("start_line", "symbol_id", "name"))).alias("symbols"))
    )


def symbol_positions(symbols: DataFrame) -> DataFrame:
    """Add ``position``: the 1-based place of each symbol in its file by start line."""
    numbered = number_rows(
        symbols.withColumn("segment", line_segment(F.col("start_line"))),
        ["path"],
        "segment",
        ["start_line", "symbol_id"],
        "position",
    )
    return numbered.drop("segment")
