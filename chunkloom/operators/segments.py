"""Ordered windows over groups of any size.

A plain window puts a whole group into one task, however large the group is. Here a
group is cut into segments along its order (a line or time range), the window runs per
segment, and one row per segment carries the state across. A group that holds a third
of all rows is thus spread over its segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT_BITS = 12
SEGMENT_LINES = 1 << SEGMENT_BITS


def line_segment(line: Column) -> Column:
    """Segment of a line number."""
    return F.shiftright(line.cast("long"), SEGMENT_BITS)


def carried(
    df: DataFrame, group: Sequence[str], segment: str, end: Column, out: str = "carried"
) -> DataFrame:
    """Per group and segment the last non-null ``end`` of the group's earlier segments.

    ``end`` is an aggregate over a segment's rows; a plain ``max`` of a number is combined
    by hash before the shuffle. Columns: group, segment and ``out``.
    """
    keys = [*group, segment]
    earlier = W.partitionBy(*group).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    ends = df.groupBy(*keys).agg(end.alias("__end"))
    return ends.select(*keys, F.last("__end", ignorenulls=True).over(earlier).alias(out))


def number_rows(
    df: DataFrame, group: Sequence[str], segment: str, order: Sequence[str], out: str
) -> DataFrame:
    """Add ``out``: the 1-based position of the row in its group."""
    keys = [*group, segment]
    local = df.withColumn("__local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    earlier = W.partitionBy(*group).orderBy(segment).rowsBetween(W.unboundedPreceding, -1)
    before = (
        df.groupBy(*keys)
        .agg(F.count("*").alias("__rows"))
        .select(*keys, F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"))
    )
    return (
        local.join(before, keys, "left")
        .withColumn(out, F.col("__local") + F.col("__before"))
        .drop("__local", "__before")
    )
