"""References found in text against plain loops."""

import random
import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.operators.lines import with_lines
from chunkloom.operators.references import gathered, identifiers, name_map, occurrences, references_from_scan

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ_09é中 .\n-", max_size=12)), max_size=8))
def test_identifiers_by_regex(lines):
    row, character, names = identifiers(pa.array(lines, pa.string()))
    # a digit run is no identifier, but what follows it may be: 9ab holds ab
    want = [(k, m.start(), m[0]) for k, line in enumerate(lines) for m in IDENTIFIER.finditer(line or "")]
    assert list(zip(row.tolist(), character.tolist(), names.to_pylist(), strict=True)) == want


def test_sliced_columns():
    column = pa.array(["skip me", "ab cd", None, "é x"])
    row, character, names = identifiers(column.slice(1))
    assert names.to_pylist() == ["ab", "cd", "x"] and row.tolist() == [0, 0, 2] and character.tolist() == [0, 3, 2]


def folders(path):
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(1, len(parts) + 1)]


def by_hand(docs, symbols):
    sites = {(s[1], s[3], s[4], s[2]) for s in symbols}
    out = []
    for path, text in docs:
        for number, line in enumerate(text.split("\n")):
            for found in IDENTIFIER.finditer(line):
                same = [s for s in symbols if s[2] == found[0]]
                if not same or (path, number, found.start(), found[0]) in sites:
                    continue
                depth = lambda s: len(set(folders(s[1])) & set(folders(path)))
                best = min(same, key=lambda s: (-depth(s), s[1], s[3], s[0]))
                out.append((best[0], found[0], path, number, found.start()))
    return sorted(out)


def frames(spark, docs, symbols):
    lines = with_lines(spark.createDataFrame(docs, "path string, text string")).repartition(3)
    return lines, spark.createDataFrame(symbols, "symbol_id long, path string, name string, start_line long, start_character long")


def test_nearest_declaration_wins(spark):
    draw = random.Random(2)
    names = ["alpha", "Beta", "g_1", "delta"]
    paths = ["/a/b/1.txt", "/a/b/2.txt", "/a/c/1.txt", "/a/3.txt", "/x/b/1.txt", "/top.txt"]
    docs = [(p, "\n".join(" ".join(draw.choice([*names, "other", "9", "é"]) for _ in range(6)) for _ in range(8))) for p in paths]
    symbols, seen = [], set()
    for k in range(12):
        path, text = draw.choice(docs)
        number = draw.randrange(8)
        found = draw.choice(list(IDENTIFIER.finditer(text.split("\n")[number])) or [None])
        if found and (path, number, found.start()) not in seen:
            seen.add((path, number, found.start()))
            symbols.append((k, path, found[0], number, found.start()))
    lines, table = frames(spark, docs, symbols)
    got = sorted(tuple(r) for r in references_from_scan(lines, table).collect())
    assert got == by_hand(docs, symbols) and len(got) > 20


def test_empty_and_long(spark):
    docs = [("/a.txt", ""), ("/b.txt", "Zed " * 50_000), ("/c.txt", "n" * 300_000)]
    lines, table = frames(spark, docs, [(1, "/b.txt", "Zed", 0, 0)])
    assert references_from_scan(lines, table).count() == 49_999
    assert references_from_scan(lines, table.where("false")).count() == 0
    assert references_from_scan(lines.where("false"), table).count() == 0
    assert occurrences(lines).count() == 50_001


def test_only_declared_names_leave_the_scan(spark):
    """A row per name and segment of a file; a path that two documents have, and a name declared again where it is used."""
    docs = [("/a.txt", "Zed other Zed\nmore Zed words"), ("/a.txt", "Zed é Zed"), ("/b.txt", "\n" * 5000 + "Zed"), ("/c.txt", "none here")]
    symbols = [(1, "/a.txt", "Zed", 0, 0), (2, "/b.txt", "Zed", 5000, 0), (3, "/q.txt", "words", 0, 0)]
    lines, table = frames(spark, docs, symbols)
    rows = gathered(lines.coalesce(1), name_map(table.select("name").distinct())).collect()
    assert {r.name for r in rows} == {"Zed", "words"} and len(rows) == 3
    assert sorted(r.segment for r in rows) == [0, 0, 1]
    got = sorted(tuple(r) for r in references_from_scan(lines, table).collect())
    assert got == [(1, "Zed", "/a.txt", 0, 6), (1, "Zed", "/a.txt", 0, 10), (1, "Zed", "/a.txt", 1, 5), (3, "words", "/a.txt", 1, 9)]
