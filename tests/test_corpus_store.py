"""The stored corpus: one version for all its tables, replays, pushed path filters."""

import pytest
from pyspark.sql import functions as F

from chunkloom.operators.lines import with_lines
from chunkloom.operators.store import REMOVE, UPSERT
from chunkloom.operators.symbols import of_few_paths
from chunkloom.plans import search, tables

PARTS = ("documents", "symbols", "hovers")


def docs(spark, texts):
    rows = [(f"/a/en/{i}.txt", text) for i, text in texts.items()]
    return with_lines(spark.createDataFrame(rows, "path string, text string"))


def changes(spark, **actions):
    return spark.createDataFrame([(f"/a/en/{k[1:]}.txt", v) for k, v in actions.items()], "path string, action string")


def state(kept, version=None):
    found = {name: sorted(map(str, kept.part(name, version).collect())) for name in PARTS}
    return found | {"chunks": sorted((r.path, r.start_line, r.end_line) for r in kept.live(version).collect())}


@pytest.fixture
def kept(spark, tmp_path):
    made = tables.corpus_store(spark, str(tmp_path / "corpus"))
    made.commit_base(docs(spark, {1: "Alpha one\nBeta two\nx", 2: "Gamma three\n" * 12, 3: ""}))
    return made


def test_a_version_pins_all_tables(spark, kept):
    before, first = kept.version(), state(kept)
    assert len(first["symbols"]) == 14 and len(first["documents"]) == 3
    kept.commit(docs(spark, {2: "Delta", 4: "Epsilon new"}), changes(spark, _2=UPSERT, _4=UPSERT, _1=REMOVE))
    after = state(kept)
    assert state(kept, before) == first
    names = sorted(r.name for r in kept.part("symbols").collect())
    assert names == ["Delta", "Epsilon"] and {r.path for r in kept.part("documents").collect()} == {f"/a/en/{k}.txt" for k in (2, 3, 4)}
    kept.compact()
    assert state(kept) == after and kept.vacuum() == [1, 2] and state(kept) == after


def test_a_replay_changes_nothing(spark, kept):
    number = kept.commit(docs(spark, {5: "Zeta"}), changes(spark, _5=UPSERT), "feed", 7)
    now = state(kept)
    assert kept.commit(docs(spark, {5: "Other"}), changes(spark, _5=UPSERT), "feed", 7) == number
    assert state(kept) == now
    # a batch that stopped before its changes were written is not seen, and is written anew under its number
    docs(spark, {6: "Lost"}).select("path", "lines").write.parquet(f"{kept.table.home}/documents/batch_id={number + 1}")
    assert state(kept) == now
    kept.commit(docs(spark, {7: "Eta"}), changes(spark, _7=UPSERT))
    assert "Lost" not in str(state(kept))


def test_an_empty_corpus(spark, tmp_path):
    none = tables.corpus_store(spark, str(tmp_path / "none"))
    assert state(none) == {"documents": [], "symbols": [], "hovers": [], "chunks": []}


def test_paths_of_a_request_are_pushed_to_the_scan(spark, kept):
    wanted = spark.createDataFrame([("/a/en/2.txt",), ("/a/en/2.txt",)], "path string")
    found = of_few_paths(kept.part("documents"), wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(path), EqualTo(path,/a/en/2.txt)" in plan or "In(path, [/a/en/2.txt])" in plan
    assert [r.path for r in found.collect()] == ["/a/en/2.txt"]
    many = of_few_paths(kept.part("documents"), wanted, few=0)
    assert "GreaterThanOrEqual(path," in many._jdf.queryExecution().executedPlan().toString()
    assert [r.path for r in many.collect()] == ["/a/en/2.txt"]


def test_a_wrong_id_among_the_hits_is_replaced(spark):
    """Only hits are checked; if one is wrong, the next sound chunk moves up as if all had been checked."""
    corpus = tables.corpus(spark, "/root/testdata/sf0.001")
    asked = tables.semantic_queries(spark, "/root/testdata/sf0.001").limit(3)
    wrong = corpus.chunks.withColumn("id", F.when(F.col("path") < "/src2", "x").otherwise(F.col("id")))
    wrong = wrong.select(*(F.col(f.name).alias(f.name, metadata=f.metadata) for f in corpus.chunks.schema))
    whole = search.Corpus(wrong, corpus.docs, corpus.symbols, corpus.hovers)
    sound = search.Corpus(wrong.where("id <> 'x'"), corpus.docs, corpus.symbols, corpus.hovers)
    got, want = (
        sorted(r.symbol_id for r in search.code_reuse_search(c, asked, ["thn"], tables.RULES, tables.EMBEDDER).semantic.collect()) for c in (whole, sound)
    )
    assert got == want and got
