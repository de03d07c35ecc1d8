"""Placement by distance, against pairs of paths."""

import os
import random
from collections import Counter

from conftest import rows

from chunkloom.config import PlacerParams
from chunkloom.operators import placement
from chunkloom.plans.place import symbols_placer
from chunkloom.sources.rules import Rule, Ruleset


def steps(a, b):
    a, b = a.strip("/").split("/"), b.strip("/").split("/")
    return len(a) + len(b) - 2 * len(os.path.commonprefix([a, b]))


def by_pairs(uses, use_max):
    """Target directory of one symbol from all pairs of its uses, repeats included."""
    totals = {c: sum(steps(c, u) for u in uses) for c in uses}
    best = (max if use_max else min)(totals.values())
    parents = Counter(os.path.dirname(c) or "/" for c in uses if totals[c] == best)
    return min(parents, key=lambda p: (-parents[p], p))


def example(spark, seed=21):
    """One symbol owns a third of all uses."""
    rnd = random.Random(seed)
    symbols = [(i, f"/{rnd.choice('abc')}/{rnd.choice('xy')}/d{i}.rs") for i in range(25)]
    uses = []
    for _ in range(600):
        who = 0 if rnd.random() < 0.34 else rnd.randrange(1, 24)
        depth = rnd.randint(0, 3)
        uses.append((who, "/" + "".join(rnd.choice("abc") + "/" for _ in range(depth)) + f"u{rnd.randrange(6)}.rs"))
    uses += [(0, "/a"), (0, "/a/b"), (5, "/b"), (5, "/b/u1.rs"), (5, "/b/u1.rs/x")]  # files that are folders too
    uses += [(i, p) for i, p in symbols for _ in range(i % 3)]  # uses in the declaring file
    declared = [(i, p, 7) for i, p in symbols]
    return (
        symbols,
        uses,
        spark.createDataFrame(declared, "symbol_id long, path string, site long"),
        spark.createDataFrame([(i, p, 100 + k) for k, (i, p) in enumerate(uses)] + declared, "symbol_id long, path string, site long"),
    )


def test_distance_sums_by_pairs(spark):
    _, uses, s, u = example(spark)
    got = {(r.symbol_id, r.path): (r.uses, r.total) for r in placement.distance_sums(placement.count_references(s, u)).collect()}
    lists = {}
    for who, path in uses:
        lists.setdefault(who, []).append(path)
    want = {(who, c): (ps.count(c), sum(steps(c, p) for p in ps)) for who, ps in lists.items() for c in ps}
    assert got == want


def test_places_by_pairs(spark):
    symbols, uses, s, u = example(spark)
    home = dict(symbols)
    for use_max in (True, False):
        got = dict(rows(placement.place_symbols(s, u, use_max), "symbol_id", "place_to"))
        want = {}
        for who in home:
            own = [p for w, p in uses if w == who]
            if own:
                target = by_pairs(own, use_max)
                if target != os.path.dirname(home[who]):
                    want[who] = target
        assert got == want


def test_uses_in_the_declaring_file_hold_a_symbol(spark):
    """Three uses at home and one elsewhere: by least distance the symbol stays."""
    s = spark.createDataFrame([(1, "/p/x/a.rs", 3)], "symbol_id long, path string, site long")
    uses = [(1, "/p/x/a.rs", 3), (1, "/p/x/a.rs", 10), (1, "/p/x/a.rs", 11), (1, "/p/x/a.rs", 12), (1, "/p/y/b.rs", 1)]
    u = spark.createDataFrame(uses, "symbol_id long, path string, site long")
    assert rows(placement.count_references(s, u)) == [(1, "/p/x/a.rs", 3), (1, "/p/y/b.rs", 1)]
    assert placement.place_symbols(s, u, use_max=False).count() == 0
    assert rows(placement.place_symbols(s, u, use_max=True), "place_to") == [("/p/y",)]
    assert rows(placement.count_references(s.drop("site"), u.drop("site")), "uses") == [(1,), (4,)]


def test_ties_and_counts(spark):
    u = spark.createDataFrame([(1, "/a/x.rs", 2), (1, "/b/x.rs", 2), (1, "/c/d/x.rs", 1)], "symbol_id long, path string, uses long")
    sums = placement.distance_sums(u)
    assert rows(placement.best_places(sums, False), "path") == [("/a/x.rs",), ("/b/x.rs",)]
    assert rows(placement.common_parent(placement.best_places(sums, False))) == [(1, "/a")]
    assert rows(placement.best_places(sums, True), "path") == [("/c/d/x.rs",)]


def test_unreferenced(spark):
    _, _, s, u = example(spark)
    assert rows(placement.unreferenced(s, u.filter("symbol_id <> 3")), "symbol_id") == [(3,)]


def test_symbols_placer(spark):
    docs = spark.createDataFrame([("/a/x.rs", ["struct One {}", "fn two() {}"])], "path string, lines array<string>")
    symbols = spark.createDataFrame(
        [(1, "/a/x.rs", "One", "Struct", 0, 0), (2, "/a/x.rs", "two", "Function", 1, 1)],
        "symbol_id long, path string, name string, kind string, start_line long, end_line long",
    )
    uses = spark.createDataFrame([(1, "/b/y.rs"), (1, "/b/z.rs"), (2, "/b/y.rs")], "symbol_id long, path string")
    ruleset = Ruleset((), (Rule((".*",), (".*",), ("**",), ("struct",), ("Move {symbols}.",)),))
    got = symbols_placer(docs, symbols, uses, ruleset, PlacerParams())
    assert rows(got.places, "symbol_id", "place_to") == [(1, "/b")]
    assert rows(got.symbols, "symbol_id", "code") == [(1, "struct One {}")]
    assert "".join(r.text for r in got.rules.orderBy("piece").collect()) == "Move One."
    assert got.json().count() == 3 + 1 + 1
