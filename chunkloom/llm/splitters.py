"""Sharding by sampled splitters: ranges of (hash of the text, doc_id) with nearly equal bytes.

Keys are sampled with a probability in proportion to their size; weighted quantiles of the sample cut
the key space into ranges, many per shard. Ranges found to be overfull are sampled again and cut
further. The exact totals of the ranges and a running sum inside each give every record its place in the
whole order, and with it shard and slot. Equal texts are neighbours; a text copied very often
is cut by doc_id, so no range depends on one key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.session import materialize


@dataclass(frozen=True)
class ShardParams:
    """``ranges`` per shard and ``samples`` per range bound what the driver holds, whatever the input."""

    shards: int = 8
    ranges: int = 64
    samples: int = 16
    rounds: int = 3


KEY = np.dtype([("hash", "<i8"), ("id", "<i8")])


def splitters(keys: np.ndarray, weights: np.ndarray, ranges: int) -> np.ndarray:
    """The keys at the weighted quantiles of a sample."""
    order = np.argsort(keys, order=("hash", "id"))
    upto = np.cumsum(weights[order])
    at = np.searchsorted(upto, np.arange(1, ranges) * (upto[-1] / ranges)) if len(upto) else []
    return np.unique(keys[order][at])


def range_of(cuts: np.ndarray):
    """A column function: the number of splitters at or below a key."""

    @F.pandas_udf("int")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hashes, ids in parts:
            keys = np.empty(len(hashes), dtype=KEY)
            keys["hash"], keys["id"] = hashes, ids
            yield pd.Series(np.searchsorted(cuts, keys, side="right").astype(np.int32))

    return place("hash", "id")


def _sampled(rows: DataFrame, chance: Column, salt: int, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    unit = F.xxhash64("hash", "id", F.lit(salt)) / F.lit(2.0**64) + F.lit(0.5)
    drawn = rows.where(unit < chance).select("hash", "id", weight.alias("weight")).toPandas()
    keys = np.empty(len(drawn), dtype=KEY)
    keys["hash"], keys["id"] = drawn["hash"], drawn["id"]
    return keys, drawn["weight"].to_numpy(dtype=float)


def sharded(
    docs: DataFrame, p: ShardParams = ShardParams(), text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with ``size`` (UTF-8 bytes + 1), ``text_crc32``, ``shard``
    (int) and ``slot`` (gapless from 0 in each shard).

    A shard's bytes differ from an equal part by less than one record. A null text has size 1, a
    null doc_id comes first among its text's copies; rows that repeat take places next to each
    other. Columns of ``docs`` named like an added one are replaced. An empty table gives no rows.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("size", "text_crc32", "shard", "slot")]
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")
    base = materialize(
        docs.select(
            F.struct(*names).alias("doc"),
            (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.crc32(whole).alias("crc"),
            hashed.alias("hash"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("id"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    rows = base.select("row", "size", "hash", "id")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = p.shards * p.ranges
    chance = F.col("size") * F.lit(ranges * p.samples / max(total, 1))
    cuts = splitters(*_sampled(rows, chance, 0, F.greatest(F.col("size") / chance, "size")), ranges)
    for salt in range(1, p.rounds + 1):
        placed = rows.withColumn("range", range_of(cuts))
        sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        over = [r["range"] for r in sums.where((F.col("bytes") > 2 * total / ranges) & (F.col("n") > 1)).collect()]
        if not over:
            break
        more = _sampled(placed.where(F.col("range").isin(over)), chance * 4**salt, salt, F.lit(1.0))[0]
        cuts = np.unique(np.concatenate([cuts, more[:: p.samples // 2]]))

    placed = materialize(rows.withColumn("range", range_of(cuts)), "ranges")
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = sums.select("range", *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "n")))
    inside = W.partitionBy("range").orderBy("hash", "id", "row")
    start = F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")
    ordered = placed.join(before, "range").select(
        "row",
        F.least(F.lit(p.shards - 1), F.floor(start * p.shards / F.lit(max(total, 1)))).cast("int").alias("shard"),
        (F.col("n_before") + F.row_number().over(inside) - 1).alias("rank"),
    )
    first = ordered.groupBy("shard").agg(F.min("rank").alias("first"))
    slots = ordered.join(first, "shard").select("row", "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"))
    return base.join(slots, "row").select("doc.*", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


#: The whole order stated at once; the table of CRC-32 is built from its polynomial.
SHARD_SQL = """
WITH tab AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce([n::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k:
      CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(n))),
d AS (
  SELECT doc_id, coalesce(text, '') AS x, strlen(coalesce(text, '')) + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
o AS (
  SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS b,
         sum(size) OVER () AS total, row_number() OVER (ORDER BY h, doc_id NULLS FIRST) AS g FROM d),
s AS (SELECT *, least(7, (b * 8) // total)::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size,
       xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(x), '..'),
         lambda p: ('0x' || p)::BIGINT)), lambda c, v: xor(c // 256, t[(xor(c, v) % 256) + 1])), 4294967295::BIGINT) AS text_crc32,
       'bytes' AS law, shard, (g - min(g) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM s, tab
"""
