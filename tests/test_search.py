"""Names, vectors, embedding and whole searches."""

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.config import ChunkParams, SearchParams
from chunkloom.operators import embedding, names, vectors
from chunkloom.operators.chunking import chunk_lines
from chunkloom.operators.render import as_document
from chunkloom.plans import registry, tables
from chunkloom.plans.search import Corpus, code_reuse_search
from chunkloom.sources.rules import Rule, Ruleset


def test_name_modes(spark):
    found = spark.createDataFrame([(i, n) for i, n in enumerate(["HttpHandler", "handler", "Hndlr", "Server", "a.b", "ab"])], "symbol_id long, name string")

    def of(patterns, mode, **kw):
        return rows(names.search_names(found, patterns, mode, **kw), "pattern_id", "rank", "name")

    assert of(["HANDLER"], "substring") == [(0, 1, "handler"), (0, 2, "HttpHandler")]
    assert of(["hdlr"], "subsequence") == [(0, 1, "Hndlr"), (0, 2, "handler"), (0, 3, "HttpHandler")]
    assert of(["a.b"], "subsequence") == [(0, 1, "a.b")]
    assert of(["handlr", "xyz"], "levenshtein") == [(0, 1, "Hndlr"), (0, 2, "handler")]
    assert of(["er", "er"], "substring", limit=1) == [(0, 1, "Server"), (1, 1, "Server")]
    assert len(of([], "substring")) == 6
    with pytest.raises(ValueError):
        of(["a"], "soundex")


def vector_table(spark, n=400, dims=8, copies=0, seed=1):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)).astype(np.float32)
    if copies:
        data[:copies] = data[0]
    return data, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<float>")


def brute(base, asked, k, metric):
    out = []
    for q, v in enumerate(asked.astype(float)):
        b = base.astype(float)
        if metric == "l2":
            d = np.sqrt(((b - v) ** 2).sum(1))
        elif metric == "dot":
            d = -(b @ v)
        else:
            d = 1 - (b @ v) / np.sqrt((b * b).sum(1) * (v * v).sum())
        order = np.lexsort((np.arange(len(b)), np.round(d, 9)))[:k]
        out += [(q, r, int(i)) for r, i in enumerate(order, 1)]
    return sorted(out)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_nearest_by_brute_force(spark, metric):
    """A third of the vectors are copies of one another; batches and partitions do not matter."""
    base, frame = vector_table(spark, copies=140)
    asked, queries = vector_table(spark, n=7, copies=0, seed=2)
    asked[0] = base[0]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    want = brute(base, asked, 9, metric)
    for parts, batch in ((1, 10000), (5, 13)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = vectors.nearest(frame.repartition(parts), queries, 9, metric)
        assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)


def test_nearest_in_blocks(spark, monkeypatch):
    """More queries than fit one block give the same rows."""
    base, frame = vector_table(spark, n=60)
    asked, _ = vector_table(spark, n=50, seed=4)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id long, embedding array<float>")
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 16)
    got = vectors.nearest(frame, queries, 3)
    assert sorted((r.query_id, r["rank"], r.id) for r in got.collect()) == brute(base, asked, 3, "l2")
    assert vectors.nearest(frame, queries.limit(0), 3).count() == 0


def test_fewer_rows_than_k(spark):
    _, frame = vector_table(spark, n=3)
    got = vectors.nearest(frame, frame.withColumnRenamed("id", "query_id").limit(1), 10)
    assert got.count() == 3


def test_cells(spark):
    """All cells probed equals the exact search; few cells recall most of it."""
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(10, 8)) * 4
    data = (middles[rng.integers(0, 10, 600)] + rng.normal(size=(600, 8)) * 0.4).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, (m + 0.1).tolist()) for i, m in enumerate(middles)], "query_id long, embedding array<double>")
    centers = vectors.train_cells(frame, 10)
    cells = vectors.assign_cells(frame, centers)
    exact = {(r.query_id, r.id) for r in vectors.nearest(frame, queries, 10).collect()}

    def of(probes):
        return {(r.query_id, r.id) for r in vectors.nearest_in_cells(cells, queries, centers, 10, probes).collect()}

    assert of(10) == exact
    assert len(of(3) & exact) / len(exact) > 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_table_rows(spark, sf):
    """Every row whose id is divisible by 20 asks the given embeddings: recall by brute force."""
    queries = tables.row_questions(spark, f"/root/testdata/{sf}")
    found = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, data = np.array([r.vec_id for r in found]), np.array([r.embedding for r in found], np.float64)
    want = {
        (int(ids[at]), int(ids[k]))
        for at in np.flatnonzero(ids % 20 == 0)
        for k in np.lexsort((ids, np.sqrt(((data - data[at]) ** 2).sum(1)).round(9)))[:10]
    }
    got = {(r.query_id, r.id) for r in registry.knn_ivf_rows(spark, f"/root/testdata/{sf}").collect()}
    assert queries.count() * 10 == len(want) == len(got)
    assert len(got & want) / len(want) >= 0.9


def test_cells_are_passed_over_by_the_bound_only(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(8, 4)) * 20
    data = (middles[rng.integers(0, 8, 400)] + rng.normal(size=(400, 4))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id long, embedding array<float>")
    queries = frame.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    cells = vectors.assign_cells(frame, middles)
    key = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    for k in (5, 120):  # 120 rows are more than a cell has
        assert key(vectors.nearest_by_bound(cells, queries, middles, k)) == key(vectors.nearest(frame, queries, k))


def test_cells_prune_a_partitioned_table(spark, tmp_path):
    _, frame = vector_table(spark)
    centers = vectors.seed_cells(frame, 6)
    vectors.assign_cells(frame, centers).write.partitionBy("cell").parquet(str(tmp_path / "cells"))
    stored = spark.read.parquet(str(tmp_path / "cells"))
    hits = vectors.nearest_in_cells(stored, frame.withColumnRenamed("id", "query_id").limit(1), centers, 5, 2)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert hits.count() == 5


def test_hash_embedder():
    model = embedding.HashEmbedder(16)
    out = model.embed(["The cat", "the\tCAT ", "", "dog"])
    assert out.shape == (4, 16)
    assert (out[0] == out[1]).all()
    assert not out[2].any()
    assert np.allclose((out[[0, 3]] ** 2).sum(1), 1)
    assert embedding.model("no such model").name == embedding.DEFAULT_MODEL


def test_policies_and_batches(spark):
    model = embedding.HashEmbedder(8)
    chunks = [["a b", "c"], [], ["a b"], ["", "x y z"]] * 5
    whole = {p: embedding._embed_rows(pa.array(chunks), model, p) for p in embedding.POLICIES}
    for policy in embedding.POLICIES:
        assert (embedding._embed_rows(pa.array(chunks), model, policy, 3) == whole[policy]).all()
    assert np.allclose(whole["mean"][0], (model.embed(["a b"])[0] + model.embed(["c"])[0]) / 2)
    assert np.allclose(whole["first_line"][0], model.embed(["a b"])[0])
    assert np.allclose(whole["concat"][0], model.embed(["a b\nc"])[0])
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(chunks)], "id int, text array<string>").repartition(3)
    for policy in embedding.POLICIES:
        for size in (2, 10000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = {r.id: r.embedding for r in embedding.embed_chunks(frame, model, policy).collect()}
            assert np.allclose([got[i] for i in range(len(chunks))], whole[policy])
    nulls = spark.createDataFrame([(1, None), (2, ["a b"])], "id int, text array<string>")
    got = {r.id: r.embedding for r in embedding.embed_chunks(nulls, model).collect()}
    assert not any(got[1]) and any(got[2])
    with pytest.raises(ValueError):
        embedding.embed_lines(F.col("text"), model, "median")


def test_own_embedder(spark):
    class Lengths:
        name, dims = "lengths", 2

        def embed(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

    embedding.register_model("lengths", Lengths)
    frame = spark.createDataFrame([(1, ["abc", "d"])], "id int, text array<string>")
    table = embedding.embed_chunks(frame, embedding.model("lengths"))
    assert table.first().embedding == [2.0, 1.0]
    embedding.check_model(table, Lengths())
    with pytest.raises(ValueError):
        embedding.check_model(table, embedding.HashEmbedder(64))


RULES = Ruleset(
    ("Common.",),
    (
        Rule(("^St",), ("t",), ("**",), (".*",), ("Seen: {% for hit in symbols %}{{ hit.kind }} {{ hit.name }}{% if not loop.last %} + {% endif %}{% endfor %}",)),
    ),
)


def small_corpus(spark, model):
    docs = spark.createDataFrame(
        [
            ("/src/a.rs", ["// opens a socket", "struct Socket<T> {", "  port: u16", "}", "", "fn other() {}"]),
            ("/src/b.rs", ["// parses yaml rules", "fn parse_rules() {", "}"]),
        ],
        "path string, lines array<string>",
    )
    found = spark.createDataFrame(
        [
            (1, "/src/a.rs", "Socket<T>", "Struct", None, 1, 0, 3, 1),
            (2, "/src/a.rs", "other", "Function", "net", 5, 0, 5, 13),
            (3, "/src/b.rs", "parse_rules", "Function", "", 1, 0, 2, 1),
        ],
        "symbol_id long, path string, name string, kind string, container_name string, start_line long,"
        " start_character long, end_line long, end_character long",
    )
    marked = "struct<language:string,value:string>"
    hovers = spark.createDataFrame(
        [("/src/b.rs", 1, 13, ((None, "parses"), None, None))],
        f"path string, line long, character long, hover struct<scalar:{marked},parts:array<{marked}>,markup:string>",
    )
    chunks = embedding.embed_chunks(chunk_lines(docs, ChunkParams(3, 1)), model)
    return Corpus(chunks, docs, found, hovers)


def test_code_reuse_search(spark):
    model = embedding.HashEmbedder(64)
    corpus = small_corpus(spark, model)
    asked = spark.createDataFrame([(0, "opens a socket")], "query_id long, text string")
    params = SearchParams(hits_per_query=1)
    found = code_reuse_search(corpus, asked, ["PRules"], RULES, model, params)
    assert rows(found.semantic, "symbol_id") == [(1,)]
    assert rows(found.fuzzy, "symbol_id", "hover", "code") == [(3, "parses", "fn parse_rules() {\n}")]
    assert rows(found.semantic_rules) == [(0, "Common."), (1, "Seen: Struct Socket&lt;T&gt;")]
    assert rows(found.fuzzy_rules) == [(0, "Common.")]
    text = as_document(found.blocks()).first().document
    assert text.index("## Semantic Rules") < text.index("- **Name:** `Socket<T>`") < text.index("## Fuzzy Rules")
    assert "- **Container:** (none)\n- **Location:**\n    - URI: `file:///src/b.rs`\n    - Range: lines 2-3, columns 1-2\n" in text
    assert "- **Hover:** parses\n- **Code:**\n```\nfn parse_rules() {\n}\n```" in text
    assert found.json().count() == 2 + 1 + 1 + 1


def test_search_in_cells(spark, tmp_path):
    """With every cell probed the answer is the exact one; the centroids survive being stored."""
    model = embedding.HashEmbedder(64)
    corpus = small_corpus(spark, model)
    vectors.save_cells(spark, vectors.seed_cells(corpus.chunks, 2), str(tmp_path / "cells"))
    centers = vectors.load_cells(spark, str(tmp_path / "cells"))
    assert centers.shape == (2, 64)
    celled = Corpus(vectors.assign_cells(corpus.chunks, centers), corpus.docs, corpus.symbols, corpus.hovers)
    asked = spark.createDataFrame([(0, "opens a socket"), (1, "yaml rules")], "query_id long, text string")
    exact = code_reuse_search(corpus, asked, ["o"], RULES, model)
    found = code_reuse_search(celled, asked, ["o"], RULES, model, SearchParams(probes=2), centroids=centers)
    assert rows(found.semantic) == rows(exact.semantic) and found.semantic.count() > 0
    assert rows(found.response("json")) == rows(exact.json())


def test_search_without_results(spark):
    model = embedding.HashEmbedder(64)
    asked = spark.createDataFrame([], "query_id long, text string")
    found = code_reuse_search(small_corpus(spark, model), asked, ["zzz"], Ruleset(), model)
    text = as_document(found.blocks()).first().document
    assert "**No semantic symbols found.**" in text and "**No fuzzy symbols found.**" in text
    assert "_No additional semantic rules specified._" in text


def test_kinds_of_a_search(spark):
    model = embedding.HashEmbedder(64)
    asked = spark.createDataFrame([], "query_id long, text string")
    found = code_reuse_search(small_corpus(spark, model), asked, [], Ruleset(), model, SearchParams(kinds=("Func",)))
    assert rows(found.fuzzy, "symbol_id") == [(2,), (3,)]
