"""Name search by an index: patterns come as a table of any size.

Every distinct name is posted under its pairs of letters, its letters, and under the empty gram. A name that
contains a pattern has all its grams, so the rarest one finds it. A name within ``k`` edits of a pattern keeps all
but ``k q`` of its grams of ``q`` letters, so one of the pattern's ``k q + 1`` rarest finds it; patterns too short for
pairs go by letters, and those of at most ``k`` letters by length alone. What is found is then compared itself, so
the result is that of a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.session import materialize

SALTS = 32


def _grams(text: str, size: Column) -> Column:
    """All runs of ``size`` letters, one per place; the empty one once for size 0."""
    last = F.length(text) - size + 1
    some = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(F.col(text), k, size))
    return F.when(size == 0, F.array(F.lit(""))).when(last >= 1, some).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class NameIndex:
    """``postings``: gram, name, low (the name in lower case); ``counts``: gram, names. Write both to reuse them."""

    postings: DataFrame
    counts: DataFrame


def build_name_index(symbols: DataFrame) -> NameIndex:
    """The index of the distinct names of ``symbols``; null is no name."""
    names = symbols.where(F.col("name").isNotNull()).select("name").distinct().select("name", F.lower("name").alias("low"))
    grams = F.array_distinct(F.flatten(F.array(*(_grams("low", F.lit(q)) for q in (0, 1, 2)))))
    postings = names.select(F.explode(grams).alias("gram"), "name", "low")
    return NameIndex(postings, postings.groupBy("gram").agg(F.count("*").alias("names")))


def _chosen(patterns: DataFrame, counts: DataFrame, size: Column, keep: Column) -> DataFrame:
    """(pattern, gram): the ``keep`` rarest grams of ``size`` letters of each pattern, repeated ones once."""
    at = F.posexplode(_grams("pattern", size)).alias("at", "gram")
    grams = patterns.select("pattern", keep.cast("int").alias("keep"), at).join(counts, "gram", "left")
    order = W.partitionBy("pattern").orderBy(F.coalesce("names", F.lit(0)), "gram", "at")
    rare = grams.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("keep"))
    return rare.select("pattern", "gram").distinct()


def matching_names(index: NameIndex, patterns: DataFrame, mode: str, max_edits: int = 2) -> DataFrame:
    """``pattern, name, score``: all names that match; ``pattern`` is distinct and in lower case."""
    length = F.length("pattern")
    if mode == "substring":
        chosen = _chosen(patterns, index.counts, F.least(length, F.lit(2)), F.lit(1))
        found = chosen.join(index.postings, "gram").withColumn("score", F.expr("instr(low, pattern)"))
        return found.where((F.col("score") > 0) | (F.col("pattern") == "")).select(
            "pattern", "name", F.when(F.col("pattern") == "", 0).otherwise(F.col("score")).alias("score")
        )
    if mode != "levenshtein":
        raise ValueError(f"no index for name mode {mode!r}")
    size = F.when(length - 1 > 2 * max_edits, 2).when(length > max_edits, 1).otherwise(0)
    chosen = _chosen(patterns, index.counts, size, size * max_edits + 1)
    near = F.abs(F.length("low") - length) <= max_edits
    pairs = chosen.join(index.postings, "gram").where(near | (F.col("pattern") == "")).select("pattern", "name", "low").distinct()
    edits = F.when(F.col("pattern") == "", 0).otherwise(F.levenshtein("low", "pattern", max_edits))
    return pairs.withColumn("score", edits).where(F.col("score") >= 0).select("pattern", "name", "score")


def search_index(
    index: NameIndex, symbols: DataFrame, patterns: DataFrame, mode: str = "substring", limit: int = 32, max_edits: int = 2
) -> DataFrame:
    """The best ``limit`` symbols per ``(pattern_id, pattern)``, as ``search_names`` ranks them: the symbols' columns with
    ``pattern_id, pattern, score, rank``. An empty pattern matches every name; a null one matches nothing.

    Names are ranked before their symbols are joined, in parts first, so a pattern that matches everything
    is no single task; what is left is written once to the shared folder. Symbols of one name rank by their ids for every pattern: of a name the first ``limit`` are joined.
    """
    asked = patterns.where(F.col("pattern").isNotNull()).select("pattern_id", "pattern", F.lower("pattern").alias("low_pattern"))
    wanted = asked.select(F.col("low_pattern").alias("pattern")).distinct()
    found = matching_names(index, wanted, mode, max_edits)
    best = ["score", F.length("name"), "name"]
    for keys in (["pattern", "salt"], ["pattern"]):
        found = found.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best))).where(F.col("rank") <= limit)
    found = materialize(found.select("pattern", "name", "score"), "names-found")
    listed = symbols.join(found.select("name").distinct(), "name", "left_semi")
    for keys in (["name", "__salt"], ["name"]):
        listed = listed.withColumn("__salt", F.pmod(F.xxhash64("symbol_id"), F.lit(SALTS)))
        listed = listed.withColumn("__nth", F.row_number().over(W.partitionBy(*keys).orderBy("symbol_id"))).where(F.col("__nth") <= limit)
    rows = found.select(F.col("pattern").alias("low_pattern"), "name", "score").join(listed.drop("__salt", "__nth"), "name")
    for keys in (["low_pattern", "salt"], ["low_pattern"]):
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("symbol_id"), F.lit(SALTS)))
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best, "symbol_id"))).where(F.col("rank") <= limit)
    return asked.join(rows.drop("salt"), "low_pattern").drop("low_pattern")
