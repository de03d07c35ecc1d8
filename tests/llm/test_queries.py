"""The registered queries of this folder, and the pipeline."""

import pytest
from compare import compare, connect

import __spark_entry__ as driver
import corpus_pipeline
from chunkloom.llm.queries import QUERIES, SQL, piece_model
from chunkloom.session import materialize

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries())
    assert {q.split("_")[0] for q in QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize("name", QUERIES)
def test_a_row_per_row_of_the_table(spark, con, name):
    diff, count, _ = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert diff == ""
    if not name.startswith(("op12", "op13")):  # these return phrases and words
        assert count == spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op2') else 'documents'}.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "repeated passages", "source mix", "pieces"]
    columns, results = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "stage")
        results.append(docs)
    assert all(r.columns == columns for r in results[:-1])
    counts = [r.count() for r in results]
    assert counts[0] >= counts[1] == counts[2] and counts[3] == counts[4] > 0
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = sorted((r.doc_id, len(library.encode(r.text, add_eos=True))) for r in results[3].collect())
    assert sorted((r.doc_id, r.n_tokens) for r in results[4].collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, results[4].collect()))


def test_pipeline_on_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    clean = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, clean, "en", "a", len(clean)), (2, clean, "en", "b", len(clean)), (3, None, None, None, None), (4, "", "en", "a", 0),
        (None, clean.replace("w", "v"), "en", None, 1), (6, clean[: len(clean) // 2] + " tail" * 30, "en", "a", 1),
    ]
    for some in ([], rows):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), "stage")
        found = docs.collect()
        assert (len(found) > 0) == (len(some) > 0)
    assert {1, None} <= {r.doc_id for r in found}
    assert not {2, 3, 4} & {r.doc_id for r in found}
