"""Views of the driver's tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.config import ChunkParams
from chunkloom.operators.chunking import chunk_lines
from chunkloom.operators.embedding import HashEmbedder, embed_chunks
from chunkloom.operators.lines import numbered_lines, with_lines
from chunkloom.operators.corpus_store import CorpusStore
from chunkloom.operators.store import ChunkStore
from chunkloom.operators.symbols import extract_symbols
from chunkloom.plans.search import Corpus
from chunkloom.session import spread
from chunkloom.sources.rules import Rule, Ruleset

PARAMS = ChunkParams(size=5, overlap=2)
EMBEDDER = HashEmbedder(64)
NAME_REGEX = "^([A-Z][a-z]+)"
# A symbol's id is its document's times this plus its line; no document has so many lines.
LINES = 1 << 32

RULES = Ruleset(
    common=("Look for an existing symbol first.", "Keep one symbol per concern."),
    depends_on=(
        Rule(
            kind=("^Struct$",),
            name=("^[A-M]",),
            path=("/src[0-4]/**",),
            code=(".*",),
            rules=(
                "Sources 0 to 4 open lines with {symbols}; quote one of them.",
                "Capitalised openings stay as they are.",
            ),
        ),
        Rule(
            kind=("Enum", "Function"),
            name=(".*",),
            path=("**/en/*.txt", "**/de/*.txt"),
            code=("tion[ .,]", "ung "),
            rules=("Names {symbols} of {symbols.kind}.",),
        ),
        Rule(kind=(), name=(".*",), path=("**",), code=(".*",), rules=("Never attached.",)),
        Rule(kind=("Enum",), name=("^T",), path=("**",), code=(".*",), rules=("First text.",)),
        Rule(kind=("Enum",), name=("^T",), path=("**",), code=(".*",), rules=("Second text.",)),
    ),
)


def document_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rules of each document: names that begin like its first word, or code that has its second word before a
    mark, in files of its language or source."""
    words = r"(?s)(?<![A-Za-z])([A-Za-z]{3,}+).*?([A-Za-z]{3,}+)"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").where(F.rlike("text", F.lit(words)))
    first, second = F.regexp_extract("text", words, 1), F.regexp_extract("text", words, 2)
    one = F.struct(
        (F.col("doc_id") * 2).alias("rule_pos"), F.array(F.lit("^Struct$"), F.lit("Enum")).alias("kind"),
        F.array(F.concat(F.lit("^"), F.substring(first, 1, 5))).alias("name"),
        F.array(F.concat(F.lit("**/"), "lang", F.lit("/*.txt"))).alias("path"), F.array(F.lit(".*")).alias("code"),
    )
    two = F.struct(
        (F.col("doc_id") * 2 + 1).alias("rule_pos"), F.array(F.lit(".*")).alias("kind"), F.array(F.lit(".")).alias("name"),
        F.array(F.concat(F.lit("/"), "source", F.lit("/**"))).alias("path"),
        F.array(F.concat(second, F.lit("[.,]"))).alias("code"),
    )
    return rows.select(F.explode(F.array(one, two)).alias("rule")).select("rule.*")


PAGE_RULES = Ruleset(
    depends_on=(
        Rule(
            kind=("Struct",),
            name=("^[a-m]",),
            path=("/*.com/**", "/*.org/en/**"),
            code=("<article>",),
            rules=("Move {symbols}.", "Link <{symbols.name}> once."),
        ),
        Rule(kind=("Enum",), name=("n$",), path=("**",), code=("lang=.fr",), rules=("French.",)),
    ),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> F.Column:
    return F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, lang, source, lines``."""
    raw = table(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"), "lang", "source", "text")
    return with_lines(spread(raw, "path"))


def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths alone; the texts are not read."""
    return table(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"), "lang", "source")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(docs(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str, keep_text: bool = False) -> DataFrame:
    return chunk_lines(docs(spark, sf_dir), PARAMS, keep_text)


def embedded_chunks(spark: SparkSession, sf_dir: str, policy: str = "mean") -> DataFrame:
    return embed_chunks(chunks(spark, sf_dir, True), EMBEDDER, policy)


def kind_by_length(name: F.Column) -> F.Column:
    rest = F.length(name) % 3
    return F.when(rest == 0, "Struct").when(rest == 1, "Function").otherwise("Enum")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol per line that starts with a capitalised word."""
    return symbols_of(docs(spark, sf_dir))


def symbols_of(documents: DataFrame) -> DataFrame:
    """Symbols of documents with ``doc_id, path, source, lines``."""
    found = extract_symbols(documents, [(kind_by_length(F.col("name")), NAME_REGEX)])
    return found.select(
        (F.col("doc_id") * LINES + F.col("start_line")).alias("symbol_id"),
        "path",
        "name",
        "kind",
        F.when(F.col("kind") == "Enum", F.col("source")).alias("container_name"),
        "start_line",
        "end_line",
        "start_character",
        "end_character",
    )


def hovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hover answers of all variants; most enums have none."""
    return hovers_of(docs(spark, sf_dir))


def hovers_of(documents: DataFrame) -> DataFrame:
    """Hovers of documents with ``path, lang, lines``."""
    marked = "struct<language: string, value: string>"
    none = F.lit(None)
    rows = numbered_lines(documents).withColumn("name", F.regexp_extract("line", NAME_REGEX, 1))
    rows = rows.filter(F.col("name") != "").withColumn("kind", kind_by_length(F.col("name")))
    plain = F.struct(none.cast("string").alias("language"), F.col("line").alias("value"))
    coded = F.struct(F.col("lang").alias("language"), F.col("line").alias("value"))
    named = F.struct(none.cast("string").alias("language"), F.col("name").alias("value"))
    scalar = F.when(F.col("kind") == "Struct", F.when(F.col("name").rlike("^[A-M]"), plain).otherwise(coded))
    parts = F.when(F.col("kind") == "Function", F.array(named, coded))
    markup = F.when((F.col("kind") == "Enum") & (F.length("line") > 200), F.col("line"))
    return rows.select(
        "path",
        F.col("line_no").cast("long").alias("line"),
        (F.length("name") - 1).cast("long").alias("character"),
        F.struct(
            scalar.cast(marked).alias("scalar"), parts.cast(f"array<{marked}>").alias("parts"), markup.alias("markup")
        ).alias("hover"),
    ).filter("hover.scalar is not null or hover.parts is not null or hover.markup is not null")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(
        embedded_chunks(spark, sf_dir), docs(spark, sf_dir), symbols(spark, sf_dir), hovers(spark, sf_dir)
    )


def from_path(documents: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` of documents, told from their paths."""
    part = lambda k: F.get(F.split("path", "/"), F.lit(k))
    return documents.withColumns({"source": part(1), "lang": part(2), "doc_id": F.regexp_extract(part(3), r"^(\d+)\.", 1).cast("long")})


def corpus_store(spark: SparkSession, root: str) -> CorpusStore:
    """A new stored corpus: chunks, symbols and hovers of the documents committed to it."""
    return CorpusStore(
        ChunkStore(spark, root, EMBEDDER.dims, EMBEDDER.name, "mean").open(),
        lambda documents: embed_chunks(chunk_lines(documents, PARAMS), EMBEDDER),
        {"symbols": lambda d: symbols_of(from_path(d)), "hovers": lambda d: hovers_of(from_path(d))},
    )


def stored_corpus(store: CorpusStore, version: int | None = None) -> Corpus:
    """All four tables of a stored corpus at one version."""
    version = store.version() if version is None else version
    return Corpus(store.live(version), *(store.part(name, version) for name in ("documents", "symbols", "hovers")))


def semantic_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark passages as questions."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different words of the benchmark as name patterns."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))
    found = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("pattern")).distinct()
    return found.select(F.col("pattern").alias("pattern_id"), "pattern")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def row_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a question."""
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 20 == 0)
    return rows.select(F.col("vec_id").alias("query_id"), "embedding")


def label_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label as a question."""
    return _centers(table(spark, sf_dir, "embeddings"), F.col("label"))


def remainder_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of the ids of each remainder by 12."""
    return _centers(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(12)))


def _centers(rows: DataFrame, group: F.Column) -> DataFrame:
    means = [F.round(F.avg(F.col("embedding")[i].cast("double")), 6) for i in range(64)]
    return rows.groupBy(group.alias("query_id")).agg(F.array(*means).alias("embedding"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/"), F.regexp_replace(bare, "/+$", "")).alias("path"), "html", "url"
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A use per link: ``page_id, path`` of the page, the linked name as ``symbol_id`` and the link's ``site``."""
    found = page_paths(spark, sf_dir).select(
        "page_id", "path", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("nth", "symbol_id")
    )
    return found.select("page_id", "path", "symbol_id", F.struct("page_id", "nth").alias("site"))


def page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, lines`` of the pages; pages of one path follow each other."""
    pages = page_paths(spark, sf_dir).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("pages"))
    return with_lines(pages.select("path", F.array_join("pages.html", "\n").alias("text")))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linked name is defined on the first page that links it, by its first link, and reaches over
    the lines of that path: ``page_extents`` gives its last line."""
    none = F.lit(0).cast("long")
    return (
        links(spark, sf_dir)
        .groupBy("symbol_id")
        .agg(F.min(F.struct("site", "path")).alias("first"))
        .select(
            "symbol_id",
            "first.site",
            F.ltrim("symbol_id", F.lit("/")).alias("name"),
            kind_by_length(F.col("symbol_id")).alias("kind"),
            "first.path",
            none.alias("start_line"),
            none.alias("end_line"),
        )
    )


def page_extents(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Symbols reach to the last line of their document."""
    last = docs.select("path", (F.size("lines") - 1).cast("long").alias("end_line"))
    return symbols.drop("end_line").join(last, "path")


EVENT_KINDS = {"signup": "create", "click": "modify", "purchase": "modify", "error": "remove", "view": "access"}


def event_feed(events: DataFrame, paths: DataFrame) -> DataFrame:
    """The events table as a change feed: ``event_id, paths, kind, ts``."""
    kind = F.lit("other")
    for name, meaning in EVENT_KINDS.items():
        kind = F.when(F.col("event_type") == name, meaning).otherwise(kind)
    return events.join(paths.select(F.col("doc_id").alias("user_id"), "path"), "user_id").select(
        "event_id", F.array("path").alias("paths"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts")
    )
