"""Sources, chunk table, change feed and its upkeep."""

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.config import ChunkParams
from chunkloom.operators import store
from chunkloom.operators.embedding import HashEmbedder, check_dims, check_model
from chunkloom.sources.documents import FileDocuments, TableDocuments
from chunkloom.sources.files import paths_of_uris, root_path, scan_documents, scan_paths
from chunkloom.streaming import changes, maintain

MODEL = HashEmbedder(8)
PARAMS = ChunkParams(3, 1)
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
EVENT = "event_id long, path string, kind string, ts timestamp"


def test_scan_files(spark, tmp_path):
    for name, data in {
        "a.rs": b"x\ny\n", "sub/b b.rs": b"w", "empty.rs": b"", "sub/deep/c.kt": b"z", "d.txt": b"no", "bad.rs": b"\xff\xfe\x00",
    }.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(data)
    root = f"file://{tmp_path}"
    found = [r[0].removeprefix(str(tmp_path)) for r in rows(scan_paths(spark, root, ["**/*.{rs,kt}"]), "path")]
    assert found == ["/a.rs", "/bad.rs", "/sub/b b.rs", "/sub/deep/c.kt"]  # not the empty one
    assert [r[0].removeprefix(str(tmp_path)) for r in rows(scan_paths(spark, root, ["*.rs"]), "path")] == ["/a.rs", "/bad.rs"]
    docs, rejects = scan_documents(spark, root, ["**/*.{rs,kt}"])
    assert {r.path.removeprefix(str(tmp_path)): r.text for r in docs.collect()} == {
        "/a.rs": "x\ny\n", "/sub/b b.rs": "w", "/sub/deep/c.kt": "z",
    }
    assert [r[0].removeprefix(str(tmp_path)) for r in rows(rejects)] == ["/bad.rs"]
    for bad in ("http://x/y", "/plain/path"):
        with pytest.raises(ValueError):
            root_path(bad)


def test_documents_of_changed_paths(spark, tmp_path):
    """Only the changed files are read, whatever signs their names hold."""
    odd = ["a\u00a0b.rs", "a\u2028b.rs", "a\u3000b.rs", "p%20q+r.rs", "[x]{y}#?.rs"]
    for name in ("a.rs", "b c.rs", "ü.rs", "d.txt", *odd):
        (tmp_path / name).write_text(f"{name}\nend\n")
    here = FileDocuments(spark, f"file://{tmp_path}", ["*.rs"])
    wanted = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in ("b c.rs", "ü.rs", "gone.rs", "d.txt")], "path string")
    want = [(f"{tmp_path}/b c.rs", ["b c.rs", "end"]), (f"{tmp_path}/ü.rs", ["ü.rs", "end"])]
    table = TableDocuments(here.of(here.paths()))
    assert here.paths().count() == 3 + len(odd)
    assert rows(here.of(wanted)) == want
    assert rows(table.of(wanted)) == want
    assert table.of(wanted.limit(0)).count() == 0 == here.of(wanted.limit(0)).count()
    every = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in odd], "path string")
    assert {r.lines[0] for r in here.of(every).collect()} == set(odd)


def test_uris(spark):
    frame = spark.createDataFrame([("file:///a",), ("untitled:1",)], "uri string")
    assert rows(paths_of_uris(frame)) == [("file:///a", "/a")]


def documents(spark, texts):
    return spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, lines array<string>")


def indexed(spark, texts):
    return maintain.index_documents(documents(spark, texts), PARAMS, MODEL)


def content(frame):
    return sorted((r.id, r.path, r.start_line, r.end_line, tuple(round(x, 9) for x in r.embedding)) for r in frame.collect())


def changed(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path string, action string")


def test_table_life(spark, tmp_path):
    table = store.ChunkStore(spark, str(tmp_path / "t"), 8).open()
    assert table.live().count() == 0
    texts = {"/a": list("abcd"), "/b": list("xy"), "/c": ["q"]}
    table.commit_base(indexed(spark, texts))
    assert content(table.live()) == content(indexed(spark, texts))
    assert table.live().schema["embedding"].dataType.simpleString() == "array<double>"

    texts["/a"] = ["new"]
    table.commit(indexed(spark, {"/a": texts["/a"]}), changed(spark, ("/a", store.UPSERT)), "s", 1)
    del texts["/b"]
    table.commit(indexed(spark, {}), changed(spark, ("/b", store.REMOVE)))
    assert content(table.live()) == content(indexed(spark, texts))

    # The same batch again changes nothing.
    table.commit(indexed(spark, {"/a": texts["/a"]}), changed(spark, ("/a", store.UPSERT)), "s", 1)
    assert content(table.live()) == content(indexed(spark, texts))

    # A removed file comes back.
    texts["/b"] = ["again"]
    table.commit(indexed(spark, {"/b": ["again"]}), changed(spark, ("/b", store.UPSERT)))
    assert content(table.live()) == content(indexed(spark, texts))

    # Rows of a batch whose changes were not written yet are not seen.
    indexed(spark, {"/c": ["half"], "/z": ["half"]}).write.parquet(f"{table.home}/chunks/batch_id=5")
    assert content(table.live()) == content(indexed(spark, texts))

    assert table.compact() == 5
    assert content(table.live()) == content(indexed(spark, texts))
    table.commit(indexed(spark, {"/c": ["fresh"]}), changed(spark, ("/c", store.UPSERT)))
    texts["/c"] = ["fresh"]
    assert content(table.live()) == content(indexed(spark, texts))
    assert table.vacuum() == [1, 2, 3, 4]
    assert content(table.live()) == content(indexed(spark, texts))
    # What was committed before the base is still not done again.
    table.commit(indexed(spark, {"/a": ["replay"]}), changed(spark, ("/a", store.UPSERT)), "s", 1)
    assert content(table.live()) == content(indexed(spark, texts))

    # Other dimensions open another table; the type of the vectors is checked.
    assert store.ChunkStore(spark, str(tmp_path / "t"), 16).open().live().count() == 0
    spark.range(1).select(F.lit("x").alias("embedding")).write.parquet(str(tmp_path / "t/dims=4/chunks/batch_id=0"))
    with pytest.raises(TypeError):
        store.ChunkStore(spark, str(tmp_path / "t"), 4).open()


def test_table_keeps_model_and_policy(spark, tmp_path):
    made = {"model": MODEL.name, "policy": "mean"}
    table = store.ChunkStore(spark, str(tmp_path / "t"), 8, **made).open()
    table.commit_base(indexed(spark, {"/a": ["x"]}))
    back = store.ChunkStore(spark, str(tmp_path / "t"), 8, **made).open().live()
    check_model(back, MODEL, "mean")
    for other in ({"model": "other"}, {"policy": "concat"}):
        with pytest.raises(ValueError):
            store.ChunkStore(spark, str(tmp_path / "t"), 8, **{**made, **other}).open()
    with pytest.raises(ValueError):
        check_model(back, MODEL, "concat")


def test_deletes_and_upserts(spark):
    old = spark.createDataFrame([("1", "/d/a"), ("2", "/d2/a"), ("3", "/d_/x"), ("4", "/d")], "id string, path string")
    assert rows(store.delete_under(old, ["/d"]), "id") == [("2",), ("3",)]
    assert rows(store.delete_ids(old, old.filter("id < '3'")), "id") == [("3",), ("4",)]
    new = spark.createDataFrame([("2", "/n"), ("2", "/n"), ("9", "/n")], "id string, path string")
    once = store.upsert_by_id(old, new)
    assert rows(once) == [("1", "/d/a"), ("2", "/n"), ("3", "/d_/x"), ("4", "/d"), ("9", "/n")]
    assert rows(store.upsert_by_id(once, new)) == rows(once)
    assert rows(store.replace_by_path(old, old.filter("id = '1'"), new.filter("id = '9'")), "id") == [("2",), ("3",), ("4",), ("9",)]
    assert rows(store.expand_folders(spark.createDataFrame([("/d",), ("/zz",)], "path string"), old)) == [("/d",), ("/d/a",)]


def test_dims(spark):
    frame = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, embedding array<double>")
    good, bad = check_dims(frame, 2)
    assert rows(good, "id") == [(1,)] and rows(bad, "id") == [(2,), (3,)]


def test_layout_prunes(spark, tmp_path):
    texts = {f"/p{i:03}": list("abcdefg") for i in range(64)}
    store.clustered(indexed(spark, texts), 4).write.parquet(str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c")).filter(store.under(F.col("path"), ["/p001"]))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,/p001/)" in plan
    assert back.count() == 4


def event_rows(seed, n=120, names=12):
    rnd = random.Random(seed)
    kinds = ["create", "modify", "modify", "remove", "access", "other"]
    hot = ["/hot"] * (names // 2)
    return [
        (i, rnd.choice(hot + [f"/f{k}" for k in range(names)]), rnd.choice(kinds), T0 + dt.timedelta(seconds=rnd.randrange(400_000)))
        for i in range(n)
    ]


def bursts(events, gap):
    out, by_path = [], {}
    for e in events:
        if e[2] in changes.ACCEPTED:
            by_path.setdefault(e[1], []).append((e[3], e[0], e[2]))
    for path, items in by_path.items():
        items.sort()
        run = [items[0]]
        for item in items[1:]:
            if item[0] - run[-1][0] > gap:
                out.append((path, run[0][0], run[-1][0], len(run), run[-1][2]))
                run = []
            run.append(item)
        out.append((path, run[0][0], run[-1][0], len(run), run[-1][2]))
    return sorted(out)


def naive(rows_):
    return sorted(tuple(v.replace(tzinfo=dt.timezone.utc) if isinstance(v, dt.datetime) else v for v in r) for r in rows_)


def local(frame):
    """Timestamps as seconds, free of the test machine's zone."""
    cols = [F.unix_timestamp(c).alias(c) if t == "timestamp" else F.col(c) for c, t in frame.dtypes]
    return sorted(tuple(r) for r in frame.select(*cols).collect())


def seconds(tuples):
    return sorted(tuple(int(v.timestamp()) if isinstance(v, dt.datetime) else v for v in t) for t in tuples)


@pytest.mark.parametrize("hours", [1, 8, 30])
def test_debounce_by_walk(spark, hours):
    """Bursts across the day segments, one path with most of the events."""
    events = event_rows(hours, 300)
    frame = changes.accept(spark.createDataFrame(events, EVENT))
    got = changes.debounce(frame, f"{hours} hours").select("path", "first_ts", "last_ts", "events", "kind")
    assert local(got) == seconds(bursts(events, dt.timedelta(hours=hours)))


def test_latest_state_and_duplicates(spark):
    events = event_rows(5)
    frame = changes.accept(spark.createDataFrame(events, EVENT))
    kept = [e for e in events if e[2] in changes.ACCEPTED]
    last = {}
    for e in sorted(kept, key=lambda e: (e[3], e[0])):
        last[e[1]] = e
    assert dict(rows(changes.latest(frame), "path", "event_id")) == {p: e[0] for p, e in last.items()}
    assert rows(changes.path_state(frame), "path", "present", "last_kind", "changes") == sorted(
        (p, e[2] != "remove", e[2], sum(k[1] == p for k in kept)) for p, e in last.items()
    )
    assert changes.deduplicate(frame.unionByName(frame)).count() == len(set(kept))
    twice = spark.createDataFrame([(1, "/a", "modify", events[0][3]), (2, "/a", "modify", events[0][3])], EVENT)
    assert rows(changes.deduplicate(twice.unionByName(twice)), "event_id") == [(1,), (2,)]
    assert rows(changes.accept(frame, ["/f?"]).select("path").distinct()) == sorted({(e[1],) for e in kept if len(e[1]) == 3})


def test_first_scan_comes_before_the_feed(spark):
    """Create events of the first scan, then the feed's last word per path."""
    known = spark.createDataFrame([("/a",), ("/b",)], "path string")
    start = changes.snapshot_events(known, F.lit(T0))
    feed = spark.createDataFrame([(1, "/b", "remove", T0), (2, "/c", "create", T0)], EVENT)
    assert rows(changes.latest(start.unionByName(feed)), "path", "kind") == [
        ("/a", "create"), ("/b", "remove"), ("/c", "create"),
    ]


def test_feed_follows_new_files(spark, tmp_path):
    """Files already there come first, later ones in the next run; a path per row."""
    feed = str(tmp_path / "feed")
    shape = changes.FEED_SCHEMA

    def arrive(*events):
        spark.createDataFrame([(i, p, k, T0) for i, p, k in events], shape).coalesce(1).write.mode("append").parquet(feed)

    arrive((1, ["/a", "/b"], "create"), (2, ["/c"], "access"))
    for _ in range(2):
        stream = changes.accept(changes.one_path_per_row(changes.read_feed(spark, feed)))
        changes.drain(stream, str(tmp_path / "out"), str(tmp_path / "check"))
        seen = rows(spark.read.parquet(str(tmp_path / "out")), "event_id", "path")
        if len(seen) == 2:
            arrive((3, ["/d"], "remove"))
    assert seen == [(1, "/a"), (1, "/b"), (3, "/d")]


def test_stream_equals_batch(spark, tmp_path):
    """Session windows on the stream give the static bursts that ended before the watermark."""
    events = event_rows(9, 200)
    feed = str(tmp_path / "feed")
    spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(feed)
    stream = changes.accept(changes.read_feed(spark, feed, EVENT))
    changes.drain(changes.debounce_stream(stream, "2 hours"), str(tmp_path / "b"), str(tmp_path / "bc"))
    got = spark.read.parquet(str(tmp_path / "b")).select("path", "first_ts", "last_ts", "events", "kind")
    end = max(e[3] for e in events if e[2] in changes.ACCEPTED) - dt.timedelta(minutes=10)
    want = [b for b in bursts(events, dt.timedelta(hours=2)) if b[2] + dt.timedelta(hours=2) <= end]
    assert local(got) == seconds(want)
    # A heartbeat past the end brings out the bursts that were still open.
    changes.beat(spark, str(tmp_path / "beats"), F.lit(T0 + dt.timedelta(days=30)))
    closed = changes.debounce_stream(changes.with_heartbeats(stream, str(tmp_path / "beats")), "2 hours")
    changes.drain(closed, str(tmp_path / "b2"), str(tmp_path / "bc2"))
    got = spark.read.parquet(str(tmp_path / "b2")).select("path", "first_ts", "last_ts", "events", "kind")
    assert local(got) == seconds(bursts(events, dt.timedelta(hours=2)))
    state = changes.path_state(stream)
    changes.drain(state, str(tmp_path / "s"), str(tmp_path / "sc"), "update")
    static = changes.path_state(changes.accept(spark.createDataFrame(events, EVENT)))
    columns = ["path", "present", "last_kind", "changes"]
    assert rows(changes.newest(spark, str(tmp_path / "s"), "path"), *columns) == rows(static, *columns)


def test_incremental_table(spark, tmp_path):
    """Micro-batches, a replay and folder events leave the table of the surviving files."""
    texts = {f"/p/f{i}.txt": [f"w{i} {j}" for j in range(i + 1)] for i in range(8)}
    texts |= {f"/q/f{i}.txt": ["q"] * i for i in range(1, 4)}
    docs = TableDocuments(documents(spark, texts))
    table = store.ChunkStore(spark, str(tmp_path / "t"), 8).open()
    table.commit_base(indexed(spark, texts))
    feed = str(tmp_path / "feed")
    steps = [
        [(1, "/p/f0.txt", "modify"), (2, "/p/f1.txt", "remove"), (3, "/p/f2.txt", "access")],
        [(4, "/q", "remove"), (5, "/p/f3.txt", "remove")],
        [(6, "/p/f3.txt", "create"), (7, "/p/f4.txt", "modify"), (8, "/p/f4.txt", "remove")],
    ]
    for n, step in enumerate(steps):
        data = [(i, p, k, T0 + dt.timedelta(seconds=i)) for i, p, k in step]
        spark.createDataFrame(data, EVENT).coalesce(1).write.mode("append").parquet(feed)
        stream = changes.read_feed(spark, feed, EVENT, files_per_trigger=1)
        maintain.follow(stream, table, docs, PARAMS, MODEL, str(tmp_path / "check"), globs=["**/*.txt"])
        if n == 1:
            table.compact()  # between two runs of one checkpoint
    gone = {"/p/f1.txt", "/p/f4.txt", "/q/f1.txt", "/q/f2.txt", "/q/f3.txt"}
    left = {p: t for p, t in texts.items() if p not in gone}
    assert content(table.live()) == content(indexed(spark, left))
    # The last micro-batch once more.
    data = [(i, p, k, T0 + dt.timedelta(seconds=i)) for i, p, k in steps[-1]]
    maintain.apply_changes(table, spark.createDataFrame(data, EVENT), docs, PARAMS, MODEL, globs=["**/*.txt"], source="once", source_batch=3)
    assert content(table.live()) == content(indexed(spark, left))
    # The removed folder comes back.
    back = [(9, "/q", "create", T0 + dt.timedelta(hours=1))]
    maintain.apply_changes(table, spark.createDataFrame(back, EVENT), docs, PARAMS, MODEL, globs=["**/*.txt"], source="once", source_batch=4)
    left |= {p: t for p, t in texts.items() if p.startswith("/q/")}
    assert content(table.live()) == content(indexed(spark, left))
