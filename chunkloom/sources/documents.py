"""Where the chunk table's upkeep gets changed documents from.

A micro-batch changes a few files. Both sources match changed paths by a join on ``path``, however many
they are, and keep what else there is from being read: a table by the range of the wanted
paths, a folder by the names of the files that the listing found for them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators.lines import with_lines
from chunkloom.sources.files import scan_documents, scan_paths

class Documents(Protocol):
    def paths(self) -> DataFrame:
        """``path`` of every document; the texts are not read."""
        ...

    def of(self, wanted: DataFrame) -> DataFrame:
        """``path, lines`` of the documents whose paths are in ``wanted``."""
        ...


class TableDocuments:
    """Documents of a table with ``path`` and ``lines``, or with ``path`` and ``text``.

    In a table clustered by path the range of the wanted paths prunes the row groups that are read.
    """

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def paths(self) -> DataFrame:
        return self.table.select("path")

    def of(self, wanted: DataFrame) -> DataFrame:
        names = wanted.select("path").distinct()
        first, last = names.agg(F.min("path"), F.max("path")).first()
        found = self.table.filter(F.col("path").between(first, last)).join(names, "path", "left_semi")
        return found.select("path", "lines") if "lines" in found.columns else with_lines(found.select("path", "text"))


class FileDocuments:
    """Documents below a root folder; files that are not UTF-8 are left out."""

    def __init__(self, spark: SparkSession, root_uri: str, globs: Sequence[str]) -> None:
        self.spark, self.root_uri, self.globs = spark, root_uri, globs

    def paths(self) -> DataFrame:
        return scan_paths(self.spark, self.root_uri, self.globs).select("path")

    def of(self, wanted: DataFrame) -> DataFrame:
        found, _ = scan_documents(self.spark, self.root_uri, self.globs, wanted)
        return with_lines(found)
