"""The registered queries of this folder: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.backoff import BACKOFF_SQL, backoff_scores
from chunkloom.llm.chain import ChainParams, chain_scores, trained
from chunkloom.llm.circulant import near_duplicates
from chunkloom.llm.collocations import COLLOCATION_SQL, collocations
from chunkloom.llm.cross_parse import languages_of, learned
from chunkloom.llm.license_scan import license_labels, license_templates
from chunkloom.llm.line_quality import line_quality
from chunkloom.llm.mixture import mixture
from chunkloom.llm.prefix_tokens import token_digests
from chunkloom.llm.quantised import embedding_duplicates
from chunkloom.llm.repeats import without_repeats
from chunkloom.llm.splitters import SHARD_SQL, sharded
from chunkloom.llm.variants import spelling_variants
from chunkloom.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """The merge-type model of the public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(_table(spark, sf_dir, "documents"), keep=["doc_id"], kept="digest")
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept_bytes").cast("string").alias("kept_sha256"))


def op2_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_quality(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words",
    )


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_scores(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = learned(docs.where(~F.col("held_out")))
    return languages_of(docs, model, keep=["doc_id", "held_out"])


def op8_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op9_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = ChainParams()
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = trained(docs, marks, ["low_quality", "toxic"], p)
    return chain_scores(docs, chain, keep=["doc_id"]).withColumn("toxic", F.col("p_toxic") > p.threshold)


def op10_prefix_table_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), piece_model())


def op11_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(_table(spark, sf_dir, "documents"), license_templates(spark), keep=["doc_id"])


def op12_prefix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_composed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_interval_tree_repeats": op1_interval_tree_repeats,
    "op2_product_quantisation": op2_product_quantisation,
    "op3_circulant_minhash": op3_circulant_minhash,
    "op4_line_quality": op4_line_quality,
    "op5_stupid_backoff": op5_stupid_backoff,
    "op6_sampled_splitters": op6_sampled_splitters,
    "op7_cross_parsing": op7_cross_parsing,
    "op8_golden_mix": op8_golden_mix,
    "op9_classifier_chain": op9_classifier_chain,
    "op10_prefix_table_tokens": op10_prefix_table_tokens,
    "op11_diagonal_licenses": op11_diagonal_licenses,
    "op12_prefix_collocations": op12_prefix_collocations,
    "op13_composed_variants": op13_composed_variants,
}
SQL: dict[str, str] = {
    "op5_stupid_backoff": BACKOFF_SQL,
    "op6_sampled_splitters": SHARD_SQL,
    "op12_prefix_collocations": COLLOCATION_SQL,
}
