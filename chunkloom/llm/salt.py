"""A join with a small table of groups, one of which may own a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(rows: DataFrame, groups: DataFrame, on: str, row: str, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``groups`` (a row per value of ``on``): every group is repeated ``salts`` times and
    its rows are dealt among the repetitions by a hash of the column ``row``."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(salts)))
    repeated = groups.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(repeated, [on, "salt"]).drop("salt")
