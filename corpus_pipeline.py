"""The corpus pipeline: the stages in order, and ``run`` over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.circulant import NearParams, near_duplicates
from chunkloom.llm.line_quality import line_quality, without_lines
from chunkloom.llm.mixture import mixed, mixture
from chunkloom.llm.prefix_tokens import token_digests
from chunkloom.llm.queries import piece_model
from chunkloom.llm.repeats import without_repeats
from chunkloom.session import materialize, ship

#: Stages that SQL cannot state (hashes choose lines' documents, signatures, tokens); tests use brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that their host repeats too often."""
    ship(spark)
    # The verdict hangs on host and text alone; texts are joined with it, not stored beside it.
    key = F.sha2(F.concat_ws("\n", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "text"), 256).alias("key")
    judged = line_quality(docs.select("source", "text", key), keep=["key"]).where("kept")
    judged = judged.groupBy("key").agg(F.first("removed_lines").alias("removed_lines"))
    kept = docs.select(F.struct(*docs.columns).alias("doc"), key).join(judged, "key")
    kept = without_lines(kept.select("doc.*", "removed_lines")).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates."""
    ship(spark)
    kept = near_duplicates(docs, NearParams(words=5, percent=80)).where("kept")
    kept = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document with a smaller doc_id has already.

    A cut may fall inside a character; what is left of it goes too.
    """
    ship(spark)
    cut = without_repeats(docs, kept="text")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_bytes").cast("string"))
    return cut.withColumn("text", text).select(
        *(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns)
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, the last one cut to the words taken."""
    ship(spark)
    rows = mixed(mixture(docs)).select(*docs.columns)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row of the mix, as digests."""
    ship(spark)
    return token_digests(docs, piece_model())


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_dedup),
    ("repeated passages", repeats),
    ("source mix", mix),
    ("pieces", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
