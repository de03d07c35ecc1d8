"""Overlapping line chunks with stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkloom.config import ChunkParams

ID_SEPARATOR = "\u0001"


def chunk_id(path: Column, start_line: Column, end_line: Column) -> Column:
    """Id of a chunk: a hash of its path and final bounds."""
    return F.sha2(
        F.concat_ws(ID_SEPARATOR, path, start_line.cast("string"), end_line.cast("string")), 256
    )


def _chunk_count(n: Column, params: ChunkParams) -> Column:
    # A further chunk starts after every full one; with an overlap the tail always
    # holds lines, without one it does only if the size does not divide the file.
    if params.overlap:
        many = F.floor((n - params.size) / params.stride) + 2
    else:
        many = F.ceil(n / params.size)
    return F.when(n == 0, 0).when(n < params.size, 1).otherwise(many).cast("int")


def chunk_lines(docs: DataFrame, params: ChunkParams, keep_text: bool = True) -> DataFrame:
    """Cut each document's ``lines`` into chunks ``(id, path, start_line, end_line[, text])``.

    The end is exclusive. Everything is computed inside the document's row: no shuffle.
    """
    n = F.size("lines")
    count = _chunk_count(n, params)

    def bounds(k: Column) -> Column:
        start = k * params.stride
        end = F.least(start + params.size, n)
        fields = [start.cast("long").alias("start_line"), end.cast("long").alias("end_line")]
        if keep_text:
            fields.append(F.slice("lines", start + 1, end - start).alias("text"))
        return F.struct(*fields)

    numbers = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: k < count)
    # Outer for the same reason as in numbered_lines.
    chunks = docs.select("path", F.inline_outer(F.transform(numbers, bounds))).filter("start_line is not null")
    chunks = chunks.withColumn("id", chunk_id(F.col("path"), F.col("start_line"), F.col("end_line")))
    return chunks.select("id", "path", "start_line", "end_line", *(["text"] if keep_text else []))


def verify_chunks(chunks: DataFrame) -> DataFrame:
    """Add ``ok``: whether the stored id agrees with the id computed from the row."""
    computed = chunk_id(F.col("path"), F.col("start_line"), F.col("end_line"))
    return chunks.withColumn("ok", F.col("id").eqNullSafe(computed))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per file: number of chunks, first and last covered line, chunk lines in total."""
    return chunks.groupBy("path").agg(
        F.count("*").alias("chunks"),
        F.min("start_line").alias("first_line"),
        F.max("end_line").alias("line_count"),
        F.sum(F.col("end_line") - F.col("start_line")).alias("chunk_lines"),
    )
