"""Extraction, as-of, ranges, code, hover and long groups."""

import random

from conftest import rows
from pyspark.sql import functions as F

from chunkloom.operators import segments, symbols
from chunkloom.operators.lines import with_lines

PLACED = "symbol_id long, path string, name string, kind string, start_line long, end_line long"


def test_extract_first_pattern_wins(spark):
    docs = with_lines(
        spark.createDataFrame([("/a.rs", "pub struct Foo {\n  x: u8\n}\nfn bar() {}\nstruct fn_like;")], "path string, text string")
    )
    found = symbols.extract_symbols(docs, [("Struct", r"struct (\w+)"), ("Function", r"fn (\w+)")])
    assert rows(found, "name", "kind", "start_line", "end_line", "start_character", "end_character") == [
        ("Foo", "Struct", 0, 2, 11, 14),
        ("bar", "Function", 3, 3, 3, 6),
        ("fn_like", "Struct", 4, 4, 7, 14),
    ]


def scan(chunks, found):
    """The rule step by step: one flag per file, set by a chunk, spent by a symbol."""
    out = []
    for path in {p for p, _ in chunks} | {s[1] for s in found}:
        marks = [(line, 0, -1) for p, line in chunks if p == path] + [(s[4], 1, s[0]) for s in found if s[1] == path]
        seen = False
        for _, is_symbol, key in sorted(marks):
            if is_symbol and seen:
                out.append(key)
            seen = not is_symbol
    return sorted(out)


def test_next_symbols_by_scan(spark):
    rnd = random.Random(11)
    chunks = [(f"/f{f}", rnd.randint(0, 30)) for f in range(40) for _ in range(rnd.randint(0, 6))]
    found = [
        (i, f"/f{rnd.randint(0, 45)}", "n", "Struct", line, line + 2)
        for i, line in enumerate(rnd.randint(0, 30) for _ in range(150))
    ]
    got = symbols.next_symbols(
        spark.createDataFrame(chunks, "path string, start_line long"), spark.createDataFrame(found, PLACED)
    )
    assert sorted(r.symbol_id for r in got.collect()) == scan(chunks, found)


def test_next_symbols_of_one_long_file(spark):
    """A file over many segments, most of them without a chunk or without a symbol."""
    rnd = random.Random(12)
    far = 20 * segments.SEGMENT_LINES
    chunks = [("/big", rnd.randrange(far)) for _ in range(60)] + [("/big", 5), ("/big", far)]
    found = [(i, "/big", "n", "Struct", rnd.randrange(far + 9000), 0) for i in range(80)]
    found += [(900, "/big", "n", "Struct", far, 0), (901, "/big", "n", "Struct", far, 0)]
    got = symbols.next_symbols(
        spark.createDataFrame(chunks, "path string, start_line long"), spark.createDataFrame(found, PLACED)
    )
    assert sorted(r.symbol_id for r in got.collect()) == scan(chunks, found)


def test_chunk_comes_first_on_a_tie(spark):
    got = symbols.next_symbols(
        spark.createDataFrame([("/f", 3)], "path string, start_line long"),
        spark.createDataFrame([(1, "/f", "a", "Enum", 3, 3), (2, "/f", "b", "Enum", 3, 3)], PLACED),
    )
    assert rows(got, "symbol_id") == [(1,)]


def test_enclosing_by_brute_force(spark):
    rnd = random.Random(13)
    chunks = [(f"/f{rnd.randint(0, 3)}", s, s + rnd.randint(1, 150)) for s in (rnd.randint(0, 400) for _ in range(30))]
    found = [(i, f"/f{rnd.randint(0, 4)}", "n", "Enum", s, s + rnd.randint(0, 200)) for i, s in enumerate(rnd.randint(0, 500) for _ in range(120))]
    got = symbols.enclosing_symbols(
        spark.createDataFrame(chunks, "path string, start_line long, end_line long"), spark.createDataFrame(found, PLACED)
    )
    want = [s[0] for s in found if any(c[0] == s[1] and s[4] < c[2] and s[5] >= c[1] for c in chunks)]
    assert sorted(r.symbol_id for r in got.collect()) == sorted(want)


def test_code_and_name_position(spark):
    docs = spark.createDataFrame([("/f", ["a Foo", "  Foo Foo", "end", ""])], "path string, lines array<string>")
    found = spark.createDataFrame(
        [
            (1, "/f", "Foo", "Struct", 0, 2),
            (2, "/f", "Foo", "Struct", 1, 1),  # nested in the first
            (3, "/f", "Nope", "Struct", 2, 99),  # past the end, name absent
            (4, "/gone", "Foo", "Struct", 0, 0),
            (5, "/f", "", "Struct", 0, 0),
            (6, "/f", "F.o", "Struct", 0, 1),  # taken literally
        ],
        PLACED,
    )
    got = symbols.attach_code(found, docs)
    assert rows(got, "symbol_id", "code", "name_line", "name_character") == [
        (1, "a Foo\n  Foo Foo\nend", 0, 4),
        (2, "  Foo Foo", 1, 4),
        (3, "end\n", None, None),
        (4, None, None, None),
        (5, "a Foo", None, None),
        (6, "a Foo\n  Foo Foo", None, None),
    ]
    known = found.withColumn("name_line", F.lit(7).cast("long")).withColumn("name_character", F.lit(8).cast("long"))
    assert rows(symbols.attach_code(known, docs).filter("symbol_id = 1"), "name_line", "name_character") == [(7, 8)]


def test_kind_filter_and_rejects(spark):
    found = spark.createDataFrame([(1, "/f", "a", "Struct", 0, 0), (2, "/f", "b", "Enum", 0, 0)], PLACED)
    assert symbols.filter_kinds(found, []).count() == 2
    assert rows(symbols.filter_kinds(found, ["^E"]), "symbol_id") == [(2,)]
    good, bad = symbols.split_rejects(found, F.when(F.col("symbol_id") == 1, True))
    assert (good.count(), bad.count()) == (1, 1)


def test_normalize(spark):
    span = "struct<start:struct<line:int,character:int>,end:struct<line:int,character:int>>"
    flat = spark.createDataFrame(
        [(1, "A", 5, "file:///a.rs", ((1, 2), (3, 4)), "m"), (2, "B", 99, "http://x", None, None)],
        f"symbol_id long, name string, kind_code int, uri string, range {span}, container_name string",
    )
    nested = spark.createDataFrame(
        [(3, "C", 23, "file:///c%20d.rs", ((5, 0), (9, 1)), ((5, 7), (5, 8)))],
        f"symbol_id long, name string, kind_code int, document_uri string, range {span}, selection_range {span}",
    )
    got = symbols.normalize_symbols(flat, nested)
    assert rows(got, "symbol_id", "kind", "path", "start_line", "end_character", "container_name", "name_position.line", "name_position.character") == [
        (1, "Class", "/a.rs", 1, 4, "m", None, None),
        (2, None, None, 0, 0, None, None, None),
        (3, "Struct", "/c d.rs", 5, 1, None, 5, 8),
    ]


def test_positions_and_groups_over_segments(spark):
    rnd = random.Random(14)
    found = [(i, "/big" if i % 3 else "/small", f"n{i}", "Enum", rnd.randrange(60000), 0) for i in range(300)]
    frame = spark.createDataFrame(found, PLACED)
    want = {}
    for path in ("/big", "/small"):
        for pos, s in enumerate(sorted((s for s in found if s[1] == path), key=lambda s: (s[4], s[0])), 1):
            want[s[0]] = pos
    assert {r.symbol_id: r.position for r in symbols.symbol_positions(frame).collect()} == want
    grouped = symbols.group_by_path(frame).collect()
    assert sum(len(r.symbols) for r in grouped) == 300
    joined = [s.symbol_id for r in sorted(grouped, key=lambda r: (r.path, r.segment)) for s in r.symbols]
    assert joined == [s[0] for s in sorted(found, key=lambda s: (s[1], s[4], s[0]))]


def test_carried_against_a_plain_walk(spark):
    rnd = random.Random(15)
    data = [("g" if rnd.random() < 0.7 else "h", i, rnd.choice([None, None, None, rnd.randint(0, 99)])) for i in range(400)]
    frame = spark.createDataFrame(data, "grp string, at long, v long").withColumn("seg", F.floor(F.col("at") / 8))
    end = F.max_by("v", F.when(F.col("v").isNotNull(), F.col("at")))
    got = {(r.grp, r.seg): r.carried for r in segments.carried(frame, ["grp"], "seg", end).collect()}
    want = {}
    for grp, at, _ in data:
        earlier = [v for g, a, v in data if g == grp and a // 8 < at // 8 and v is not None]
        want[grp, at // 8] = earlier[-1] if earlier else None
    assert got == want
