"""The chunk table on Parquet.

Layout below ``root/dims=<n>``: ``chunks/batch_id=<b>`` holds the rows written by a batch and
``changes/batch_id=<b>`` what the batch did to which path. The table numbers its batches itself, so
streams, compactions and single commits follow each other in any order; a commit may name its
source and the source's own number, and what was committed under that name is not done again.
A batch counts once its changes are written, which happens last. Readers
take, per path, the rows of the newest batch that changed it, so an update writes the
changed files only and never rewrites the table. ``compact`` writes a clustered base from
time to time; older batches are then ignored, and ``vacuum`` removes them. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.functions.paths import prefixes

UPSERT, REMOVE, BASE = "upsert", "remove", "base"
CHANGES_SCHEMA = "path string, action string, source string, source_batch bigint, batch_id bigint"


def chunk_schema(ndims: int, **made_by: str | None) -> T.StructType:
    """The persisted row; the vector's length, and its model and policy, are kept in the column's metadata."""
    meta = {"ndims": ndims, **{k: v for k, v in made_by.items() if v is not None}}
    return T.StructType(
        [
            T.StructField("id", T.StringType(), False),
            T.StructField("path", T.StringType(), False),
            T.StructField("start_line", T.LongType(), False),
            T.StructField("end_line", T.LongType(), False),
            T.StructField("embedding", T.ArrayType(T.DoubleType()), False, meta),
        ]
    )


def clustered(chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """Order rows by path and line so that row-group statistics prune path predicates.

    The range is over both columns, which also splits a file with very many chunks.
    """
    keys = ["path", "start_line"]
    ranged = chunks.repartitionByRange(partitions, *keys) if partitions else chunks.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


def clustered_documents(docs: DataFrame) -> DataFrame:
    """Order documents by path before they are chunked and embedded.

    A document is one row, so its chunks come out ordered by path and line, and neither
    the sampling of the ranges nor the shuffle has to carry vectors.
    """
    return docs.repartitionByRange("path").sortWithinPartitions("path")


def under(path: Column, folders: Sequence[str]) -> Column:
    """Whether a path is one of the folders or lies below one."""
    hit = F.lit(False)
    for folder in folders:
        hit = hit | (path == folder) | path.startswith(folder.rstrip("/") + "/")
    return hit


def delete_under(chunks: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Rows outside the given files and folders. Equality and prefix reach the Parquet scan."""
    return chunks.filter(~under(F.col("path"), folders))


def delete_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("id"), "id", "left_anti")


def expand_folders(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Known paths that equal one of ``paths`` or lie below one, as an equi-join on ancestors."""
    ancestors = known.select("path", F.explode(prefixes(F.col("path"))).alias("ancestor"))
    wanted = paths.select(F.col("path").alias("ancestor")).distinct()
    return ancestors.join(wanted, "ancestor", "left_semi").select("path").distinct()


def upsert_by_id(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the ids of ``new``, and ``new`` with each id once."""
    fresh = new.dropDuplicates(["id"])
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh)


def replace_by_path(old: DataFrame, changed: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` without the changed paths, and the new rows."""
    gone = changed.select("path").distinct()
    return old.join(gone, "path", "left_anti").unionByName(new)


@dataclass(frozen=True)
class ChunkStore:
    """A chunk table; another ``ndims`` opens another table, empty at first.

    ``model`` and ``policy`` say how its vectors are made; a table made otherwise is refused.
    """

    spark: SparkSession
    root: str
    ndims: int
    model: str | None = None
    policy: str | None = None

    @property
    def home(self) -> str:
        return f"{self.root.rstrip('/')}/dims={self.ndims}"

    def _read(self, part: str, schema: T.StructType | str | None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.option("basePath", f"{self.home}/{part}").parquet(f"{self.home}/{part}")
        except AnalysisException as err:
            if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def open(self) -> ChunkStore:
        """Check the stored vector column; a table that does not exist yet is fine."""
        stored = self._read("chunks", None)
        if stored is not None and stored.columns:
            field = stored.schema["embedding"]
            if field.dataType.simpleString() != "array<double>":
                raise TypeError(f"{self.home}: embedding is {field.dataType.simpleString()}, not array<double>")
            self._check(field.metadata or {})
        return self

    def _check(self, meta: dict) -> None:
        for name, mine in (("ndims", self.ndims), ("model", self.model), ("policy", self.policy)):
            if mine is not None and meta.get(name, mine) != mine:
                raise ValueError(f"{self.home}: {name} is {meta[name]!r}, not {mine!r}")

    def schema(self) -> T.StructType:
        return chunk_schema(self.ndims, model=self.model, policy=self.policy)

    def changes(self) -> DataFrame:
        got = self._read("changes", CHANGES_SCHEMA)
        return got if got is not None else self.spark.createDataFrame([], CHANGES_SCHEMA)

    def committed(self, source: str, source_batch: int | None) -> int | None:
        """The number under which ``source`` has committed its batch before."""
        if source_batch is None:
            return None
        again = self.changes().filter((F.col("source") == source) & (F.col("source_batch") == source_batch))
        row = again.select("batch_id").first()
        return None if row is None else row[0]

    def commit(self, chunks: DataFrame, changes: DataFrame, source: str = "", source_batch: int | None = None) -> int:
        """Write a batch: the new rows, then ``(path, action)`` of every path it changed. Returns its number.

        With ``source_batch``, a batch that ``source`` has committed before is left as it is.
        """
        self._check(chunks.schema["embedding"].metadata or {})
        if (before := self.committed(source, source_batch)) is not None:
            return before
        batch_id = self.version() + 1
        rows = chunks.select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.schema()])
        rows.write.mode("overwrite").parquet(f"{self.home}/chunks/batch_id={batch_id}")
        named = F.lit(source).alias("source"), F.lit(source_batch).cast("bigint").alias("source_batch")
        changes.select("path", "action", *named).write.mode("overwrite").parquet(
            f"{self.home}/changes/batch_id={batch_id}"
        )
        return batch_id

    def commit_base(self, chunks: DataFrame) -> int:
        """Write the whole table, rows clustered by path: readers ignore every earlier batch."""
        marker = self.spark.range(1).select(F.lit("").alias("path"), F.lit(BASE).alias("action"))
        return self.commit(chunks, marker)

    def _base(self, version: int | None = None) -> int:
        found = self.changes().filter(F.col("action") == BASE)
        if version is not None:
            found = found.filter(F.col("batch_id") <= version)
        row = found.agg(F.max("batch_id")).first()
        return -1 if row is None or row[0] is None else int(row[0])

    def version(self) -> int:
        """The number of the newest batch; 0 for a new table."""
        return int(self.changes().agg(F.max("batch_id")).first()[0] or 0)

    def live(self, version: int | None = None) -> DataFrame:
        """The current rows, or those that were current at a ``version``."""
        return self.live_part("chunks", self.schema(), version)

    def live_part(self, part: str, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The current rows of ``chunks`` or of a table kept beside it by the same batches.

        Only paths changed after the base are looked up; that side is small between two
        compactions and AQE broadcasts it when its measured size allows, so the base is
        read without a shuffle. Filters by path reach the scan.
        """
        rows = self._read(part, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))
        if rows is None:
            return self.spark.createDataFrame([], schema)
        changes = self.changes()
        if version is not None:
            changes = changes.filter(F.col("batch_id") <= version)
        base = self._base(version)
        changes = changes.filter(F.col("batch_id") >= base)
        committed = changes.select("batch_id").distinct()
        last = (
            changes.filter(F.col("action") != BASE)
            .groupBy("path")
            .agg(F.max(F.struct("batch_id", "action")).alias("last"))
        )
        current = F.col("last").isNull() | (
            (F.col("last.batch_id") == F.col("batch_id")) & (F.col("last.action") == UPSERT)
        )
        return (
            rows.filter(F.col("batch_id") >= base)
            .join(committed, "batch_id", "left_semi")
            .join(last, "path", "left")
            .filter(current)
            .select(*schema.fieldNames())
        )

    def compact(self) -> int:
        """Write the current rows as a new base."""
        return self.commit_base(clustered(self.live()))

    def vacuum(self, parts: Sequence[str] = ("chunks",)) -> list[int]:
        """Remove the rows of batches before the base, which no new reader looks at; their list of changes stays,
        so that what they committed is not done again. Readers that began before the base must be over."""
        base = self._base()
        old = self.changes().filter(F.col("batch_id") < base).select("batch_id").distinct().collect()
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        for row in old:
            for part in parts:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.home}/{part}/batch_id={row[0]}")
                path.getFileSystem(hadoop).delete(path, True)
        return sorted(row[0] for row in old)
