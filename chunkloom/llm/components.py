"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.session import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) for every id that has a link; the component's id is its smallest member.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them.
    Minima are combined before the shuffle and come back by a join that AQE may split, so that
    a node with very many links is no single task. Rounds grow with the logarithm of the longest
    chain; each is written to the shared folder. Self-links and repeated links change nothing; no
    links give no rows; nulls are dropped.
    """
    u, v = F.col("u"), F.col("v")
    edges = (
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    edges = materialize(edges, "links")
    before = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        after = (
            large.join(small, "u")
            .where("v <> m")
            .select(v.alias("u"), F.col("m").alias("v"))
            .unionAll(small.select("u", F.col("m").alias("v")))
            .distinct()
        )
        edges = materialize(after, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            members = edges.groupBy(u.alias("id")).agg(F.min("v").alias("component_id"))
            return members.unionAll(edges.select(v.alias("id"), v.alias("component_id")).distinct())
        before = state
