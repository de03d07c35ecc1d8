"""Keeping the chunk table fresh from a change stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.config import ChunkParams
from chunkloom.functions.patterns import glob_match
from chunkloom.operators.chunking import chunk_lines
from chunkloom.operators.embedding import Embedder, embed_chunks
from chunkloom.operators.corpus_store import CorpusStore
from chunkloom.operators.store import REMOVE, UPSERT, ChunkStore, expand_folders
from chunkloom.session import materialize
from chunkloom.sources.documents import Documents
from chunkloom.streaming.bursts import Bursts
from chunkloom.streaming.changes import LATE, accept, action, latest


def index_documents(docs: DataFrame, params: ChunkParams, embedder: Embedder, policy: str = "mean") -> DataFrame:
    """Rows of the chunk table for documents with ``path`` and ``lines``. No shuffle."""
    return embed_chunks(chunk_lines(docs, params), embedder, policy)


def apply_changes(
    store: ChunkStore | CorpusStore,
    events: DataFrame,
    docs: Documents,
    params: ChunkParams,
    embedder: Embedder,
    policy: str = "mean",
    globs: Sequence[str] = (),
    source: str = "",
    source_batch: int | None = None,
) -> None:
    """Apply one micro-batch: re-chunk the files it creates or changes, drop those it removes. A ``CorpusStore``
    makes its chunks and all else itself.

    The last event of a path decides, and only changed documents are read; these events are written
    once for all that follows. A path that does not match ``globs`` is taken for a
    folder and stands for the known files below it; such events are rare, and only they
    make the path columns of documents and table be read.
    """
    last = materialize(latest(accept(events)).select("path", action().alias("action")), "events")
    files = last.filter(glob_match(F.col("path"), globs)) if globs else last
    upserts = files.filter(F.col("action") == UPSERT).select("path")
    removes = files.filter(F.col("action") == REMOVE).select("path")
    if globs:
        folders = last.filter(~glob_match(F.col("path"), globs))
        if not folders.isEmpty():
            known = docs.paths().filter(glob_match(F.col("path"), globs))
            back = expand_folders(folders.filter(F.col("action") == UPSERT), known)
            gone = expand_folders(folders.filter(F.col("action") == REMOVE), store.live().select("path").distinct())
            upserts = upserts.unionByName(back).distinct()
            removes = removes.unionByName(gone).distinct().join(upserts, "path", "left_anti")
    changed = docs.of(upserts)
    changes = upserts.withColumn("action", F.lit(UPSERT)).unionByName(removes.withColumn("action", F.lit(REMOVE)))
    rows = changed if isinstance(store, CorpusStore) else index_documents(changed, params, embedder, policy)
    store.commit(rows, changes, source, source_batch)


def follow(
    events: DataFrame,
    store: ChunkStore | CorpusStore,
    docs: Documents,
    params: ChunkParams,
    embedder: Embedder,
    checkpoint: str,
    policy: str = "mean",
    globs: Sequence[str] = (),
) -> None:
    """Run a change stream over what has arrived. The table knows micro-batches by the stream's id, which
    its checkpoint keeps, and their number: a replay after a failure is done once, a new checkpoint is
    another stream."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        named = store.spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        apply_changes(store, batch, docs, params, embedder, policy, globs, named, batch_id)

    query = (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(apply)
        .start()
    )
    query.awaitTermination()


def follow_bursts(
    events: DataFrame,
    store: ChunkStore | CorpusStore,
    docs: Documents,
    params: ChunkParams,
    embedder: Embedder,
    checkpoint: str,
    gap: str,
    delay: str = LATE,
    policy: str = "mean",
    globs: Sequence[str] = (),
) -> Bursts:
    """``follow`` with debouncing in front: a file is indexed when its burst of changes is over, once, by its last event.
    Bursts go on across micro-batches and restarts; late events are kept aside. Returns the state with them."""
    bursts = Bursts(store.spark, f"{checkpoint}/bursts", gap, delay)

    def apply(batch: DataFrame, batch_id: int) -> None:
        named = store.spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]
        closed = bursts.step(batch, batch_id)
        ended = closed.select(F.lit(0).cast("long").alias("event_id"), "path", "kind", F.col("last_ts").alias("ts"))
        apply_changes(store, ended, docs, params, embedder, policy, globs, named, batch_id)

    query = events.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()
    query.awaitTermination()
    return bursts
