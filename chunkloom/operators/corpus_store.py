"""A stored corpus: documents, chunks, symbols and hovers under one version.

The tables lie beside the chunk table and share its batches: a batch writes the documents it changes, what
is derived from them, the chunks, and last the list of changed paths, which makes all of it visible at
once. A version is a batch number, and every table read at a version shows the same state of each path.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.operators.store import BASE, ChunkStore, clustered_documents

DOCUMENTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("lines", T.ArrayType(T.StringType()))])


@dataclass(frozen=True)
class CorpusStore:
    """``chunks`` makes the chunk rows of documents ``(path, lines)``; ``derived`` the rows of further tables, such as
    ``symbols`` and ``hovers``, each with a ``path`` and nothing but its own document to go by."""

    table: ChunkStore
    chunks: Callable[[DataFrame], DataFrame]
    derived: Mapping[str, Callable[[DataFrame], DataFrame]]

    @property
    def spark(self) -> SparkSession:
        return self.table.spark

    def commit(self, docs: DataFrame, changes: DataFrame, source: str = "", source_batch: int | None = None) -> int:
        """Write a batch: documents ``(path, lines)`` that are new or changed, and ``(path, action)`` of every changed path.

        The documents are read once; the rest is derived from what was written. A replayed batch is left as it is.
        """
        if (before := self.table.committed(source, source_batch)) is not None:
            return before
        batch = self.table.version() + 1
        docs.select("path", "lines").write.mode("overwrite").parquet(self._folder("documents", batch))
        written = self.spark.read.schema(DOCUMENTS).parquet(self._folder("documents", batch))
        for name, make in self.derived.items():
            make(written).write.mode("overwrite").parquet(self._folder(name, batch))
        return self.table.commit(self.chunks(written), changes, source, source_batch)

    def _folder(self, part: str, batch: int) -> str:
        return f"{self.table.home}/{part}/batch_id={batch}"

    def commit_base(self, docs: DataFrame) -> int:
        """Write the whole corpus, clustered by path: readers ignore every earlier batch."""
        marker = self.spark.range(1).select(F.lit("").alias("path"), F.lit(BASE).alias("action"))
        return self.commit(clustered_documents(docs), marker)

    def version(self) -> int:
        return self.table.version()

    def live(self, version: int | None = None) -> DataFrame:
        return self.table.live(version)

    def part(self, name: str, version: int | None = None) -> DataFrame:
        """The rows of ``documents`` or of a derived table at a version, the newest by default."""
        if name == "documents":
            return self.table.live_part(name, DOCUMENTS, version)
        schema = self.derived[name](self.spark.createDataFrame([], DOCUMENTS)).schema
        return self.table.live_part(name, schema, version)

    def compact(self) -> int:
        """Write the current documents as a new base."""
        return self.commit_base(self.part("documents"))

    def vacuum(self) -> list[int]:
        return self.table.vacuum(("chunks", "documents", *self.derived))
