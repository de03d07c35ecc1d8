"""Name search: every pattern of a request against every symbol."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _score(name: Column, pattern: str, mode: str, max_edits: int) -> Column:
    """Rank value of a match, smaller is better; null if the name does not match."""
    wanted = pattern.lower()
    if wanted == "":
        return F.lit(0)
    if mode == "substring":
        at = F.instr(name, wanted)
        return F.when(at > 0, at)
    if mode == "subsequence":
        return F.when(name.rlike("(?s)" + ".*".join(re.escape(c) for c in wanted)), F.lit(0))
    if mode == "levenshtein":
        edits = F.levenshtein(name, F.lit(wanted), max_edits)
        return F.when(edits >= 0, edits)
    raise ValueError(f"unknown name mode {mode!r}")


def search_names(
    symbols: DataFrame,
    patterns: Sequence[str],
    mode: str = "subsequence",
    limit: int = 32,
    max_edits: int = 2,
) -> DataFrame:
    """The best ``limit`` symbols per pattern, with ``pattern_id``, ``pattern`` and ``rank``.

    Matching ignores case. No pattern at all asks for every symbol. The patterns are
    literals of one projection that emits matches only, so there is no join; the limit per
    pattern is applied per partition before the shuffle.
    """
    wanted = list(patterns) or [""]
    name = F.lower("name")
    scored = [
        F.when(score.isNotNull(), F.struct(F.lit(i).alias("pattern_id"), score.alias("score")))
        for i, score in ((i, _score(name, p, mode, max_edits).cast("int")) for i, p in enumerate(wanted))
    ]
    texts = F.array(*[F.lit(p) for p in wanted])
    matches = symbols.withColumn("__match", F.explode(F.array_compact(F.array(*scored))))
    ranked = W.partitionBy("pattern_id").orderBy("score", F.length("name"), "name", "symbol_id")
    return (
        matches.withColumn("pattern_id", F.col("__match.pattern_id"))
        .withColumn("score", F.col("__match.score"))
        .drop("__match")
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= limit)
        .withColumn("pattern", F.get(texts, F.col("pattern_id")))
    )
