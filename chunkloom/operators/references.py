"""References from text: where declared names occur, and which declaration an occurrence means.

A name may be declared in many files. An occurrence means the declaration that lies nearest: in its own file,
else in the deepest folder above it that holds one, there the first by path and line. Declarations are
reduced to one per name and folder on the way up, and occurrences to one per name and file, so both meet by
(name, folder) with work linear in their paths' depth; no occurrence is paired with all declarations of its name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.paths import prefixes
from chunkloom.operators.lines import numbered_lines
from chunkloom.operators.segments import SEGMENT_BITS, line_segment
from chunkloom.session import materialize

#: Bits of the map of declared names that goes to the tasks.
NAME_BITS = 24
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), ord("_")]] = True
_PART = _LETTER.copy()
_PART[ord("0") : ord("9") + 1] = True


def identifiers(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, character and text of the identifiers of each row: ASCII letters, digits and underscores, not led by a digit.

    Whole batches at once, on their bytes; characters count code points.
    """
    column = lines.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    part = _PART[data]
    opens = part.copy()
    opens[1:] &= ~part[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = part[edges]
    closes = part.copy()
    closes[:-1] &= ~part[1:]
    closes[edges[edges > 0] - 1] = part[edges[edges > 0] - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    # a run begins with its first letter
    letters = np.append(np.flatnonzero(_LETTER[data]), len(data))
    start = letters[np.searchsorted(letters, start)]
    start, end = start[start < end], end[start < end]
    row = np.searchsorted(offsets, start, side="right") - 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    size = end - start
    first = np.append(0, np.cumsum(size))
    at = np.arange(first[-1]) + np.repeat(start - first[:-1], size)
    names = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(first.astype(np.int64).tobytes()), pa.py_buffer(data[at].tobytes())])
    return row, points[start] - points[offsets[row]], names.cast(pa.string())


def occurrences(docs: DataFrame) -> DataFrame:
    """``path, line, character, name`` of every identifier of documents with ``lines``. No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, character, names = identifiers(batch.column("line"))
            taken = batch.select(["path", "line_no"]).take(pa.array(row))
            yield pa.record_batch([*taken.columns, pa.array(character.astype(np.int64)), names], names=["path", "line", "character", "name"])

    lines = numbered_lines(docs.select("path", "lines")).select("path", F.col("line_no").cast("long").alias("line_no"), "line")
    return lines.mapInArrow(scan, "path string, line long, character long, name string")


def name_map(named: DataFrame) -> np.ndarray:
    """A bit for every ``name``: 2^NAME_BITS of them in 64-bit words, whatever the number of names. Runs a job."""
    at = F.shiftright(F.crc32("name"), 32 - NAME_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(crc32(name), {32 - NAME_BITS}) & 63L as int))")
    words = named.where("name is not null").groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (NAME_BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def gathered(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``path, segment, name, places``: the occurrences of a name in a segment of a file's lines as one list of
    ``(line, character)``, or a few: a batch makes its own. Names outside the map ``bits`` are left out. No shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, character, names = identifiers(batch.column("line"))
            coded = names.dictionary_encode()
            at = np.array([zlib.crc32(n.encode("utf-8")) >> (32 - NAME_BITS) for n in coded.dictionary.to_pylist()], np.uint64)
            known = (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            kept = np.flatnonzero(known[coded.indices.to_numpy()])
            if not len(kept):
                continue
            row, character, names = row[kept], character[kept], names.take(pa.array(kept))
            taken = batch.select(["path", "line_no"]).take(pa.array(row))
            line = taken.column("line_no").to_numpy()
            codes = [c.dictionary_encode("encode").indices.to_numpy() for c in (names, taken.column("path"))]
            keys = (codes[0], line >> SEGMENT_BITS, codes[1])
            order = np.lexsort(keys)
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
            starts = np.flatnonzero(new)
            first = pa.array(order[starts])
            places = pa.StructArray.from_arrays([pa.array(line[order]), pa.array(character[order].astype(np.int64))], ["line", "character"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), places)
            yield pa.record_batch(
                [taken.column("path").take(first), pa.array(line[order[starts]] >> SEGMENT_BITS), names.take(first), lists],
                names=["path", "segment", "name", "places"],
            )

    lines = numbered_lines(docs.select("path", "lines")).select("path", F.col("line_no").cast("long").alias("line_no"), "line")
    return lines.mapInArrow(scan, "path string, segment long, name string, places array<struct<line: long, character: long>>")


def nearest_declarations(used: DataFrame, symbols: DataFrame) -> DataFrame:
    """``name, path, symbol_id``: what each ``(name, path)`` of ``used`` means; names without a declaration are left out."""
    place = F.struct("path", "start_line", "symbol_id")
    declared = symbols.select("name", place.alias("place"), F.explode(prefixes(F.col("path"))).alias("folder"))
    declared = declared.groupBy("name", "folder").agg(F.min("place").alias("place"))
    asked = used.select("name", "path").distinct().select("name", "path", F.posexplode(prefixes(F.col("path"))).alias("depth", "folder"))
    found = asked.join(declared, ["name", "folder"]).groupBy("name", "path").agg(F.max_by("place", "depth").alias("place"))
    return found.select("name", "path", "place.symbol_id")


def references_from_scan(docs: DataFrame, symbols: DataFrame) -> DataFrame:
    """``symbol_id, name, path, line, character``: every place of ``docs`` that names a symbol, without the declarations.

    ``symbols`` has ``symbol_id, path, name, start_line, start_character``; its declaration stands there. A map of the
    declared names goes to every task, so that other identifiers are left where they are read. Occurrences travel as a row per name and segment of a file; those of declared names are written once
    to the shared folder.
    """
    named = materialize(symbols.select("name").distinct(), "declared-names")
    site = F.struct(F.col("start_line").cast("long").alias("line"), F.col("start_character").cast("long").alias("character"))
    sites = symbols.groupBy("path", line_segment(F.col("start_line")).alias("segment"), "name").agg(F.collect_set(site).alias("sites"))
    found = gathered(docs, name_map(named)).join(named, "name", "left_semi").join(sites, ["path", "segment", "name"], "left")
    others = F.when(F.col("sites").isNull(), F.col("places")).otherwise(F.filter("places", lambda p: ~F.array_contains("sites", p)))
    found = materialize(found.select("path", "name", others.alias("places")).where(F.size("places") > 0), "occurrences")
    meant = nearest_declarations(found, symbols)
    return found.join(meant, ["name", "path"]).select("symbol_id", "name", "path", F.inline("places"))
