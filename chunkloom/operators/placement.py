"""Where a symbol should live, judged by the places that use it.

References are first reduced to ``(symbol_id, path, uses)``. The sum of distances from a
candidate to all uses is taken from prefix counts instead of candidate x use pairs:
``distance(a, b) = |a| + |b| - 2 * common(a, b)``, and the common parts of ``a`` with all
uses add up to the number of uses below each prefix of ``a``. The work is linear in the
number of paths times their depth, also for a symbol that is used everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.functions.paths import components, parent_path, prefixes


def count_references(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """``(symbol_id, path, uses)`` of the symbols' uses, without the declaration itself.

    ``symbols``: ``symbol_id, path``; ``references``: ``symbol_id, path`` per use, or with a
    number of ``uses``. With a ``site`` in both (a place within the path), references at the
    declaration's site are left out; other uses in its file count. Without one, the references are
    taken to leave the declaration out already. Counts are combined before the join, so a hot
    symbol joins one row per file.
    """
    one = F.col("uses") if "uses" in references.columns else F.lit(1)
    counts = references.groupBy("symbol_id", "path").agg(F.sum(one).cast("long").alias("uses"))
    if "site" in references.columns and "site" in symbols.columns:
        own = references.join(symbols.select("symbol_id", "path", "site"), ["symbol_id", "path", "site"], "left_semi")
        own = own.groupBy("symbol_id", "path").agg(F.sum(one).cast("long").alias("own"))
        counts = counts.join(own, ["symbol_id", "path"], "left").select(
            "symbol_id", "path", (F.col("uses") - F.coalesce("own", F.lit(0))).alias("uses")
        )
    return counts.filter("uses > 0").join(symbols.select("symbol_id").distinct(), "symbol_id", "left_semi")


def unreferenced(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Symbols that nothing refers to."""
    return symbols.join(references.select("symbol_id").distinct(), "symbol_id", "left_anti")


def distance_sums(uses: DataFrame) -> DataFrame:
    """Per candidate file the sum of its path distances to all uses: ``symbol_id, path, uses, total``."""
    depth = F.size(components(F.col("path")))
    counts = (
        uses.select(
            "symbol_id",
            "uses",
            (F.col("uses") * depth).alias("steps"),
            F.explode(prefixes(F.col("path"))).alias("prefix"),
        )
        .groupBy("symbol_id", "prefix")
        .agg(F.sum("uses").alias("below"), F.sum("steps").alias("steps"))
    )
    candidates = uses.select(
        "symbol_id",
        "path",
        "uses",
        depth.cast("long").alias("depth"),
        F.explode(prefixes(F.col("path"))).alias("prefix"),
    )
    # The root prefix counts all uses: it carries the terms that do not depend on the
    # common part.
    share = F.when(F.col("prefix") == "", F.col("below") * F.col("depth") + F.col("steps")).otherwise(
        F.col("below") * -2
    )
    return (
        candidates.join(counts, ["symbol_id", "prefix"])
        .groupBy("symbol_id", "path", "uses")
        .agg(F.sum(share).alias("total"))
    )


def best_places(sums: DataFrame, use_max: bool = True) -> DataFrame:
    """The candidates with the largest (or smallest) total of their symbol, all ties kept."""
    pick = F.max("total") if use_max else F.min("total")
    best = sums.groupBy("symbol_id").agg(pick.alias("total"))
    return sums.join(best, ["symbol_id", "total"], "left_semi")


def common_parent(places: DataFrame) -> DataFrame:
    """``(symbol_id, place_to)``: the directory most places lie in, repeated uses counting.

    Ties go to the directory that sorts first.
    """
    return (
        places.groupBy("symbol_id", parent_path(F.col("path")).alias("parent"))
        .agg(F.sum("uses").alias("uses"))
        .groupBy("symbol_id")
        .agg(F.min(F.struct((-F.col("uses")).alias("n"), "parent")).alias("best"))
        .select("symbol_id", F.col("best.parent").alias("place_to"))
    )


def place_symbols(symbols: DataFrame, references: DataFrame, use_max: bool = True) -> DataFrame:
    """Symbols with a better directory in ``place_to``; those already there are left out."""
    uses = count_references(symbols, references)
    target = common_parent(best_places(distance_sums(uses), use_max))
    return symbols.join(target, "symbol_id").filter(
        ~parent_path(F.col("path")).eqNullSafe(F.col("place_to"))
    )
