"""Change events: sources, filters, debouncing and per-path state, as batches and streams.

Events are ``(event_id, path, kind, ts)``. The same functions serve static and streaming
frames unless their name says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions.patterns import glob_match

ACCEPTED = ("create", "modify", "remove")
LATE = "10 minutes"
FEED_SCHEMA = "event_id bigint, paths array<string>, kind string, ts timestamp"


def read_feed(
    spark: SparkSession, folder: str, schema: str | T.StructType = FEED_SCHEMA, files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """A stream of Parquet event files: those already there first, then new ones."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def one_path_per_row(feed: DataFrame) -> DataFrame:
    """One row per path of an event that names several."""
    return feed.select("event_id", F.explode("paths").alias("path"), "kind", "ts")


def accept(events: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """Keep create, modify and remove events; with ``globs`` only those of matching paths."""
    kept = events.filter(F.col("kind").isin(*ACCEPTED))
    return kept.filter(glob_match(F.col("path"), globs)) if globs else kept


def action() -> Column:
    """What an event asks for."""
    return F.when(F.col("kind") == "remove", "remove").otherwise("upsert")


def snapshot_events(paths: DataFrame, at: Column) -> DataFrame:
    """Create events for the files of the first scan."""
    return paths.select(F.lit(-1).cast("long").alias("event_id"), "path", F.lit("create").alias("kind"), at.alias("ts"))


def snapshot_then_feed(paths: DataFrame, feed: DataFrame, at: Column) -> DataFrame:
    """One stream of the first scan and of the changes after it: ``paths`` (a stream of the known files) as create events
    at the time ``at``, which no change precedes, and ``feed``. One checkpoint holds how far both were read, so that a
    restart in the middle goes on where it stopped. The files have no limit per micro-batch, so the first one takes them
    all; of what it takes of the feed, the later times win.
    """
    columns = ["event_id", "path", "kind", "ts"]
    return snapshot_events(paths, at).select(*columns).unionByName(feed.select(*columns))


def latest(events: DataFrame) -> DataFrame:
    """The last event per path; combined before the shuffle, so a busy path is one row per task."""
    last = F.max_by(F.struct("kind", "event_id", "ts"), F.struct("ts", "event_id")).alias("last")
    return events.groupBy("path").agg(last).select("path", "last.*")


def debounce(events: DataFrame, gap: str, segment: str = "1 day") -> DataFrame:
    """Static form: one row per burst of a path, events less than ``gap`` apart forming a burst.

    Columns ``path, first_ts, last_ts, events, kind`` with the burst's last kind. A path's
    timeline is cut into segments and the open burst carried over, so that a path with
    very many events is spread.
    """
    wait = F.expr(f"interval {gap}")
    timed = events.withColumn("segment", F.window("ts", segment).start)
    order = W.partitionBy("path", "segment").orderBy("ts", "event_id")
    opened = F.when(F.col("ts") > F.col("before") + wait, F.col("ts"))
    local = timed.withColumn("before", F.lag("ts").over(order)).withColumn(
        "inner", F.max(opened).over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    # Bursts within a segment; the one without an inner start may continue an earlier burst.
    parts = local.groupBy("path", "segment", "inner").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("events"),
        F.max_by("kind", F.struct("ts", "event_id")).alias("kind"),
    )
    along = W.partitionBy("path").orderBy("segment")
    previous = F.lag("segment_last").over(along)
    heads = (
        parts.groupBy("path", "segment")
        .agg(F.min("start").alias("segment_start"), F.max("last_ts").alias("segment_last"), F.max("inner").alias("inner"))
        .withColumn("fresh", F.coalesce(F.col("segment_start") > previous + wait, F.lit(True)))
        .withColumn("open", F.coalesce("inner", F.when(F.col("fresh"), F.col("segment_start"))))
        .withColumn("earlier", F.last("open", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)))
        .select("path", "segment", F.when(F.col("fresh"), F.col("segment_start")).otherwise(F.col("earlier")).alias("head"))
    )
    return (
        parts.join(heads, ["path", "segment"])
        .groupBy("path", F.coalesce("inner", "head").alias("first_ts"))
        .agg(F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"), F.max_by("kind", "last_ts").alias("kind"))
    )


def debounce_stream(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Streaming form, by session windows. A burst is emitted once the watermark has passed
    its end. Bursts still open stay in the state until later events, or a heartbeat, move the
    watermark on."""
    return (
        events.withWatermark("ts", late)
        .groupBy("path", F.session_window("ts", gap).alias("burst"))
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count("*").alias("events"),
            F.max_by("kind", F.struct("ts", "event_id")).alias("kind"),
        )
        # Heartbeats go by an aggregate: a filter by path would be pushed below the watermark.
        .filter(F.col("kind").isNotNull())
        .drop("burst")
    )


def with_heartbeats(events: DataFrame, folder: str) -> DataFrame:
    """A stream of events joined by the heartbeats written to ``folder``: events without a path, which move the
    watermark on when the feed is silent or has ended, so that open bursts come out."""
    spark = events.sparkSession
    columns = events.select("event_id", "path", "kind", "ts")
    beats = spark.readStream.schema(columns.schema).parquet(folder)
    return columns.unionByName(beats)


def beat(spark: SparkSession, folder: str, at: Column) -> None:
    """Write one heartbeat that says that nothing before ``at`` is still to come."""
    none = F.lit(None)
    row = spark.range(1).select(
        none.cast("bigint").alias("event_id"), none.cast("string").alias("path"), none.cast("string").alias("kind"), at.alias("ts")
    )
    row.write.mode("append").parquet(folder)


def deduplicate(events: DataFrame, late: str = LATE) -> DataFrame:
    """Repeated deliveries of one event once; on a stream the state is bounded by the watermark.

    Two events of a path at one instant stay two.
    """
    keys = ["event_id", "path", "kind", "ts"]
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def path_state(events: DataFrame) -> DataFrame:
    """Per path whether it exists, its last kind and its number of changes; on a stream use
    update mode."""
    last = F.max_by("kind", F.struct("ts", "event_id"))
    return events.groupBy("path").agg(
        (last != "remove").alias("present"), last.alias("last_kind"), F.count("*").alias("changes")
    )


def path_state_ttl(events: DataFrame, ttl: str, late: str = LATE) -> DataFrame:
    """Streaming keyed state that forgets: ``path, present, last_kind, changes`` after each micro-batch that touches a path.

    ``changes`` counts the events since the path was last removed, or silent for longer than ``ttl``. A removed path
    leaves the state at once, a silent one when the watermark passes its last event by ``ttl``, so that the
    state holds the paths that live. Use update mode.
    """
    import pandas as pd

    span = pd.Timedelta(ttl)

    def advance(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        count, last = state.get if state.exists else (0, None)
        last = None if last is None else pd.Timestamp(last, unit="us")
        # a run of events ends with a removal and after a long silence
        silent = rows["ts"].diff() > span
        if last is not None:
            silent.iloc[0] = rows["ts"].iloc[0] - last > span
        ended = silent | (rows["kind"].shift() == "remove")
        starts = ended.to_numpy().nonzero()[0]
        count = len(rows) - starts[-1] if len(starts) else count + len(rows)
        kind, ts = rows["kind"].iloc[-1], rows["ts"].iloc[-1]
        if kind == "remove":
            if state.exists:
                state.remove()
        else:
            state.update((int(count), ts.value // 1000))
            state.setTimeoutTimestamp(max(int((ts + span).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"path": [key[0]], "present": [kind != "remove"], "last_kind": [kind], "changes": [int(count)]})

    return (
        events.select("event_id", "path", "kind", "ts")
        .withWatermark("ts", late)
        .groupBy("path")
        .applyInPandasWithState(
            advance, "path string, present boolean, last_kind string, changes long", "changes long, last_us long", "update", "EventTimeTimeout"
        )
    )


def drain(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what has arrived and write it below ``folder``.

    Append mode writes through the exactly-once file sink. Update mode writes one folder
    per micro-batch, overwritten on replay; read it with ``newest``.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", folder).start()
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

        query = writer.outputMode(mode).foreachBatch(write).start()
    query.awaitTermination()


def newest(spark: SparkSession, folder: str, key: str) -> DataFrame:
    """The last written row per key of a drained update stream."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (key, "batch_id")]
    last = F.max_by(F.struct(*values), F.col("batch_id")).alias("last")
    return rows.groupBy(key).agg(last).select(key, "last.*")
