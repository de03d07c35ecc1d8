"""Code of symbols from segments of files, and one stream of snapshot and feed."""

import datetime as dt
import random

from pyspark.sql import functions as F
from test_store import EVENT, MODEL, PARAMS, T0, content, documents, indexed

from chunkloom.operators import store
from chunkloom.operators.lines import numbered_lines
from chunkloom.operators.segments import SEGMENT_LINES
from chunkloom.operators.symbols import attach_code, attach_code_segments, line_segments
from chunkloom.sources.documents import TableDocuments
from chunkloom.streaming import changes, maintain

SYMBOL = "symbol_id long, path string, name string, start_line long, end_line long, code string"


def test_segments_equal_whole_files(spark):
    draw = random.Random(7)
    texts = {f"/f{k}": [draw.choice(["ab", "c ab", "", "é x"]) for _ in range(n)] for k, n in enumerate((0, 1, SEGMENT_LINES, 3 * SEGMENT_LINES + 5))}
    docs = documents(spark, texts)
    symbols = []
    for k in range(200):
        path = draw.choice([*texts, "/missing"])
        a = draw.randint(0, 3 * SEGMENT_LINES + 20)
        symbols.append((k, path, draw.choice(["ab", "x", "zz", ""]), a, a + draw.choice([-3, 0, 1, 50, 2 * SEGMENT_LINES]), "old"))
    rows = spark.createDataFrame(symbols, SYMBOL).repartition(3)
    segments = line_segments(numbered_lines(docs))
    assert segments.agg(F.max(F.size("lines"))).first()[0] == SEGMENT_LINES
    found, want = (
        {r.symbol_id: (r.code or "", r.name_line, r.name_character) for r in df.collect()}
        for df in (attach_code_segments(rows, segments), attach_code(rows, docs))
    )
    assert found == want
    known = rows.withColumns({"name_line": F.lit(5).cast("long"), "name_character": F.lit(6).cast("long")})
    assert {(r.name_line, r.name_character) for r in attach_code_segments(known, segments).collect()} == {(5, 6)}


def test_a_file_of_ten_million_lines(spark):
    lines = spark.range(10_000_000).select(F.lit("/big").alias("path"), F.col("id").alias("line_no"), F.concat(F.lit("l"), "id").alias("line"))
    rows = spark.createDataFrame([(1, "/big", "l9000001", 9_000_000, 9_000_002, ""), (2, "/big", "nil", 5, 9, ""), (3, "/big", "l4100", 4095, 4100, "")], SYMBOL)
    got = {r.symbol_id: r for r in attach_code_segments(rows, line_segments(lines)).collect()}
    assert (got[1].code, got[1].name_line, got[1].name_character) == ("l9000000\nl9000001\nl9000002", 9_000_001, 7)
    assert got[2].code == "\n".join(f"l{k}" for k in range(5, 10)) and got[2].name_line is None
    assert got[3].code.count("\n") == 5 and got[3].name_line == 4100


def test_one_stream_of_snapshot_and_feed(spark, tmp_path):
    """A restart in the middle loses and repeats nothing."""
    texts = {f"/p/f{i}.txt": [f"w{i} {j}" for j in range(i + 1)] for i in range(6)}
    docs = TableDocuments(documents(spark, texts))
    files, feed = str(tmp_path / "files"), str(tmp_path / "feed")
    spark.createDataFrame([(p,) for p in list(texts)[:5]], "path string").coalesce(1).write.parquet(files)
    table = store.ChunkStore(spark, str(tmp_path / "t"), 8).open()
    batches = [[(1, "/p/f0.txt", "remove")], [(2, "/p/f5.txt", "create"), (3, "/p/f1.txt", "remove")], [(4, "/p/f1.txt", "create")]]
    for number, batch in enumerate(batches):
        events = [(i, p, k, T0 + dt.timedelta(seconds=i)) for i, p, k in batch]
        spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(feed)
        if number == 0:
            continue  # the first run finds two files of events
        known = changes.read_feed(spark, files, "path string")
        stream = changes.snapshot_then_feed(known, changes.read_feed(spark, feed, EVENT, files_per_trigger=1), F.to_timestamp(F.lit("1970-01-01")))
        maintain.follow(stream, table, docs, PARAMS, MODEL, str(tmp_path / "check"))
    left = {p: t for p, t in texts.items() if p != "/p/f0.txt"}
    assert content(table.live()) == content(indexed(spark, left))
    named = table.changes().groupBy("path").count().collect()
    assert {r.path: r["count"] for r in named} == {"/p/f0.txt": 1, "/p/f1.txt": 3, **{f"/p/f{k}.txt": 1 for k in (2, 3, 4, 5)}}
