"""Documents to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_array(text: Column) -> Column:
    """Lines of a text without their terminators (``\\n`` or ``\\r\\n``); no lines for an empty text."""
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    body = F.when(unix.endswith("\n"), F.left(unix, F.length(unix) - 1)).otherwise(unix)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text column by ``lines``; the whole file stays one row, so no shuffle follows."""
    return docs.withColumn("lines", line_array(F.col(text))).drop(text)


def numbered_lines(docs: DataFrame) -> DataFrame:
    """One row per line with the 0-based ``line_no`` and the file's line count ``n``.

    ``docs`` has ``lines``; its other columns are kept.
    """
    # The outer form keeps the optimizer from testing, and so computing, the split twice
    # more ahead of the explode.
    keep = [c for c in docs.columns if c != "lines"]
    rows = docs.select(
        *keep, F.size("lines").alias("n"), F.posexplode_outer("lines").alias("line_no", "line")
    )
    return rows.filter(F.col("line_no").isNotNull())
