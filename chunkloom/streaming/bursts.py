"""Bursts across micro-batches: event time decides when a burst ends and which events come too late.

Each micro-batch joins its events to the bursts still open and moves the limit, the largest time seen less the
delay. A burst that ended more than the gap before the limit is closed and handed on; the others stay open.
Events older than the limit their batch began with are late: they change nothing, and are kept and counted in a table
of their own. A batch writes its state under its number and reads that of the one before, so that a replay
writes the same again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chunkloom.streaming.changes import LATE, accept, debounce

BURST = "path string, first_ts timestamp, last_ts timestamp, events long, kind string"


@dataclass(frozen=True)
class Bursts:
    """The open bursts of a feed, below ``folder``, by batch number."""

    spark: SparkSession
    folder: str
    gap: str
    delay: str = LATE

    def _at(self, part: str, batch: int) -> str:
        return f"{self.folder}/{part}/batch_id={batch}"

    def _before(self, batch: int) -> tuple[DataFrame, object]:
        if batch == 0:
            return self.spark.createDataFrame([], BURST), None
        limit = self.spark.read.parquet(self._at("limit", batch - 1)).first()[0]
        return self.spark.read.schema(BURST).parquet(self._at("open", batch - 1)), limit

    def step(self, events: DataFrame, batch: int) -> DataFrame:
        """Take the events ``(event_id, path, kind, ts)`` of batch number ``batch``; returns the bursts it closes. An event without a
        path is a heartbeat: it only moves the limit. Two events at one instant: the later batch tells the kind."""
        held, limit = self._before(batch)
        latest = events.agg(F.expr(f"max(ts) - interval {self.delay}")).first()[0]
        after = max((x for x in (limit, latest) if x is not None), default=None)
        wanted = accept(events).where(F.col("path").isNotNull())
        on_time = F.lit(True) if limit is None else F.col("ts") >= F.lit(limit)
        wanted.where(~on_time).select("event_id", "path", "kind", "ts").write.mode("overwrite").parquet(self._at("late", batch))
        fresh = debounce(wanted.where(on_time), self.gap).withColumn("turn", F.lit(1))
        rows = held.withColumn("turn", F.lit(0)).unionByName(fresh)
        # Few rows per path: what is open and the bursts of one batch.
        order = W.partitionBy("path").orderBy("first_ts", "last_ts", "turn")
        reach = F.max("last_ts").over(order.rowsBetween(W.unboundedPreceding, -1))
        opens = F.coalesce(F.col("first_ts") > reach + F.expr(f"interval {self.gap}"), F.lit(True))
        rows = rows.withColumn("opens", opens.cast("int")).withColumn("burst", F.sum("opens").over(order))
        merged = rows.groupBy("path", "burst").agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"),
            F.max_by("kind", F.struct("last_ts", "turn")).alias("kind"),
        )
        over = F.lit(False) if after is None else F.col("last_ts") + F.expr(f"interval {self.gap}") < F.lit(after)
        whole = merged.drop("burst").withColumn("over", over)
        whole.write.mode("overwrite").parquet(self._at("merged", batch))
        whole = self.spark.read.schema(f"{BURST}, over boolean").parquet(self._at("merged", batch))
        whole.where("not over").drop("over").write.mode("overwrite").parquet(self._at("open", batch))
        # The limit comes last: with it the batch is complete for the next one.
        self.spark.range(1).select(F.lit(after).cast("timestamp").alias("limit")).write.mode("overwrite").parquet(self._at("limit", batch))
        if batch > 1:
            self._forget(batch - 2)
        return whole.where("over").drop("over")

    def _forget(self, batch: int) -> None:
        """State that no replay needs any more; late events stay."""
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for part in ("open", "merged", "limit"):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._at(part, batch))
            path.getFileSystem(hadoop).delete(path, True)

    def late(self) -> DataFrame:
        """``event_id, path, kind, ts, batch_id``: the events that came too late."""
        shape = "event_id long, path string, kind string, ts timestamp, batch_id long"
        try:
            return self.spark.read.schema(shape).parquet(f"{self.folder}/late")
        except AnalysisException as err:
            if err.getCondition() == "PATH_NOT_FOUND":
                return self.spark.createDataFrame([], shape)
            raise
