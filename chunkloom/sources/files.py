"""File scans."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions.patterns import glob_match, glob_to_regex
from chunkloom.functions.paths import uri_to_path
from chunkloom.operators.symbols import split_rejects


def root_path(root_uri: str) -> str:
    """Path of a ``file:`` root; any other scheme is an error."""
    parts = urlsplit(root_uri)
    if parts.scheme != "file" or not parts.path.startswith("/"):
        raise ValueError(f"not a file URL: {root_uri}")
    return unquote(parts.path).rstrip("/") or "/"


def _scan(spark: SparkSession, root_uri: str, globs: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    root = root_path(root_uri)
    for glob in globs:
        glob_to_regex(glob)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .load(root)
    )
    # The reader gives "file:/a/b" without an authority.
    path = F.regexp_replace("path", "^file:/*", "/")
    if only is not None:
        # The listing names the wanted files in the reader's own spelling; a filter by name keeps
        # other files from being opened.
        listed = files.select(path.alias("path"), F.col("_metadata.file_path").alias("name"))
        names = [r["name"] for r in listed.join(only.select("path").distinct(), "path", "left_semi").collect()]
        files = files.filter(F.col("_metadata.file_path").isin(names))
    inside = F.substring(path, len(root) + 2 if root != "/" else 2, 1 << 30)
    return files.withColumn("path", path).filter(glob_match(inside, globs))


def scan_paths(spark: SparkSession, root_uri: str, globs: Sequence[str]) -> DataFrame:
    """Regular files below the root whose relative path matches a glob. Contents are not read.

    Spark's reader passes over files of length zero; they have no lines and no chunks.
    """
    return _scan(spark, root_uri, globs).select("path", "length", F.col("modificationTime").alias("modified"))


def scan_documents(
    spark: SparkSession, root_uri: str, globs: Sequence[str], only: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(path, text)`` of the matching files, and the paths of files that are not UTF-8.

    Small files share a task by the reader's own split packing. ``only`` restricts the scan to the
    absolute paths in its column ``path``; the other files are listed but not read. Runs a job then.
    """
    files = _scan(spark, root_uri, globs, only).select("path", "content")
    good, bad = split_rejects(files, F.is_valid_utf8(F.col("content").cast("string")))
    return good.select("path", F.col("content").cast("string").alias("text")), bad.select("path")


def paths_of_uris(uris: DataFrame, uri: str = "uri") -> DataFrame:
    """Add ``path`` and drop rows whose URI names no local file."""
    return uris.withColumn("path", uri_to_path(F.col(uri))).filter(F.col("path").isNotNull())
