"""Chunk rule, ids and statistics on hand-made files."""

import random

import pytest
from conftest import rows

from chunkloom.config import ChunkParams, EngineConfig, SearchParams, load_config
from chunkloom.operators.chunking import chunk_lines, chunk_stats, verify_chunks
from chunkloom.operators.lines import numbered_lines, with_lines
from pyspark.sql import functions as F


def documents(spark, texts):
    return with_lines(spark.createDataFrame(list(texts.items()), "path string, text string"))


def by_hand(lines, size, overlap):
    """Chunks by feeding one line after the other."""
    out, start, held, n = [], 0, [], 0
    for line in lines:
        held.append(line)
        n += 1
        if len(held) == size:
            out.append((start, start + size, list(held)))
            start = start + size - overlap
            held = held[len(held) - overlap :] if overlap else []
    if held:
        out.append((start, start + len(held), held))
    return out


def test_line_endings(spark):
    docs = documents(
        spark,
        {"a": "", "b": "\n", "c": "x", "d": "x\n", "e": "x\r\ny\r\n", "f": "x\n\n", "g": "x\r\r\ny", "h": "x\r"},
    )
    got = {r.path: list(r.lines) for r in docs.collect()}
    assert got == {
        "a": [], "b": [""], "c": ["x"], "d": ["x"], "e": ["x", "y"], "f": ["x", ""], "g": ["x\r", "y"], "h": ["x\r"],
    }
    assert rows(numbered_lines(docs).filter("path in ('a', 'f')"), "path", "line_no", "line", "n") == [
        ("f", 0, "x", 2),
        ("f", 1, "", 2),
    ]


@pytest.mark.parametrize("size,overlap", [(5, 2), (5, 0), (5, 4), (1, 0), (3, 1)])
def test_chunks_by_feeding_lines(spark, size, overlap):
    rnd = random.Random(size * 10 + overlap)
    texts = {f"/f{n}": [rnd.choice("abc") * rnd.randint(0, 3) for _ in range(n)] for n in range(23)}
    frame = spark.createDataFrame(list(texts.items()), "path string, lines array<string>")
    got = chunk_lines(frame, ChunkParams(size, overlap))
    found = {}
    for r in got.collect():
        found.setdefault(r.path, []).append((r.start_line, r.end_line, list(r.text)))
    for path, lines in texts.items():
        assert sorted(found.get(path, [])) == sorted(by_hand(lines, size, overlap)), path
    assert got.select("id").distinct().count() == got.count()


def test_chunks_cover_and_rebuild(spark):
    rnd = random.Random(3)
    texts = {f"/f{n}": [str(rnd.random()) for _ in range(n)] for n in (1, 4, 5, 6, 11, 50)}
    frame = spark.createDataFrame(list(texts.items()), "path string, lines array<string>")
    for path, lines in texts.items():
        parts = sorted(
            (r.start_line, list(r.text)) for r in chunk_lines(frame, ChunkParams(5, 2)).filter(F.col("path") == path).collect()
        )
        rebuilt = []
        for start, text in parts:
            assert start <= len(rebuilt)
            rebuilt += text[len(rebuilt) - start :]
        assert rebuilt == lines


def test_chunks_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(f"/f{i}", [str(j) for j in range(i)]) for i in range(40)], "path string, lines array<string>")
    one = rows(chunk_lines(frame.coalesce(1), ChunkParams(), False))
    assert one == rows(chunk_lines(frame.repartition(7), ChunkParams(), False))


def test_no_shuffle_for_chunks(spark):
    frame = spark.createDataFrame([("/f", ["a"])], "path string, lines array<string>")
    plan = chunk_lines(frame, ChunkParams())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_damaged_id_is_found(spark):
    frame = spark.createDataFrame([("/f", list("abcdefgh"))], "path string, lines array<string>")
    chunks = chunk_lines(frame, ChunkParams(), False)
    moved = chunks.withColumn("end_line", F.when(F.col("start_line") == 3, 7).otherwise(F.col("end_line")))
    assert rows(verify_chunks(moved), "start_line", "ok") == [(0, True), (3, False), (6, True)]


def test_stats(spark):
    frame = spark.createDataFrame([("/f", list("abcdefgh")), ("/e", [])], "path string, lines array<string>")
    assert rows(chunk_stats(chunk_lines(frame, ChunkParams(), False))) == [("/f", 3, 0, 8, 12)]


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, 5), (5, -1), (1, 1)])
def test_bad_chunk_parameters(size, overlap):
    with pytest.raises(ValueError):
        ChunkParams(size, overlap)


def test_bad_parameters():
    for bad in (
        lambda: SearchParams(hits_per_query=0),
        lambda: SearchParams(metric="l1"),
        lambda: SearchParams(name_mode="soundex"),
        lambda: EngineConfig(embed_batch=0),
        lambda: EngineConfig(response="xml"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_config_file(tmp_path):
    file = tmp_path / "config.yml"
    file.write_text(
        "debounce_sec: 2\nresponse: Json\nrules: r.yml\nplacer: {final_symbol_kinds: [Trait], use_max_distance: false}\n"
        "search:\n  fuzzy: {server_options: {workspace: {symbol: {search: {limit: 5}}}}}\n"
        "  semantic: {chunk_size: 7, overlap_size: 3, batch_size: 9, search_limit: 4, pattern: '**/*.kt', index_embeddings: true}\n"
    )
    got = load_config(file)
    assert (got.chunks, got.globs, got.embed_batch, got.index_embeddings) == (ChunkParams(7, 3), ("**/*.kt",), 9, True)
    assert (got.search.hits_per_query, got.search.symbols_per_pattern) == (4, 5)
    assert (got.placer.kinds, got.placer.use_max_distance) == (("Trait",), False)
    assert (got.debounce, got.response, got.rules) == ("2 seconds", "json", "r.yml")
    file.write_text("{}")
    assert load_config(file).chunks == ChunkParams(5, 2)
    file.write_text("search: {semantic: {chunk_size: 2, overlap_size: 2}}")
    with pytest.raises(ValueError):
        load_config(file)
