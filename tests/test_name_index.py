"""The index of names against the scan of all names."""

import random

import pytest

from chunkloom.operators.name_index import build_name_index, matching_names, search_index
from chunkloom.operators.names import search_names

SCHEMA = "symbol_id long, name string, score int, salt string"


def table(spark, names):
    return spark.createDataFrame([(k, n, 7, "own") for k, n in enumerate(names)], SCHEMA).repartition(3)


def key(df):
    return sorted((r.pattern, r["rank"], r.score, r.symbol_id) for r in df.collect())


@pytest.mark.parametrize("mode", ["substring", "levenshtein"])
def test_equal_to_the_scan(spark, mode):
    draw = random.Random(11)
    names = ["".join(draw.choice("abAé_") for _ in range(draw.randint(0, 9))) for _ in range(400)]
    names += ["aaaaaaaa"] * 60 + ["Straße", "ÉCOLE", "i", ""]
    patterns = sorted({"", "a", "é", "AB", "aaaa", "aaaaaaab", "école", "zz", "stra", *(draw.choice(names) for _ in range(30))})
    rows = table(spark, names)
    asked = spark.createDataFrame([(k, p) for k, p in enumerate(patterns)] + [(99, None)], "pattern_id int, pattern string")
    plain = rows.drop("score", "salt")
    for edits in (1, 2):
        got = search_index(build_name_index(plain), plain, asked, mode, 20, edits)
        assert key(got) == key(search_names(plain, patterns, mode, 20, edits))


def test_clashing_columns_and_empty_tables(spark):
    rows = table(spark, ["Alpha", "beta", None])
    asked = spark.createDataFrame([(1, "alph"), (2, "alph")], "pattern_id int, pattern string")
    found = search_index(build_name_index(rows), rows.drop("score", "salt"), asked).collect()
    assert sorted((r.pattern_id, r.name, r["rank"]) for r in found) == [(1, "Alpha", 1), (2, "Alpha", 1)]
    none = rows.where("false").drop("score", "salt")
    assert search_index(build_name_index(none), none, asked).count() == 0
    assert search_index(build_name_index(rows), rows.drop("score", "salt"), asked.where("false")).count() == 0


def test_the_rarest_gram_is_looked_up(spark):
    """A pattern meets the names of one of its grams, not all names."""
    rows = table(spark, [f"common{k}" for k in range(300)] + ["commonzq"])
    index = build_name_index(rows)
    asked = spark.createDataFrame([("mmonzq",)], "pattern string")
    joined = index.postings.join(index.counts, "gram").where("gram = 'zq'")
    assert joined.first().names == 1
    assert [r.name for r in matching_names(index, asked, "substring").collect()] == ["commonzq"]


def test_of_a_name_only_the_first_symbols_are_joined(spark):
    """A name of many symbols, found by many patterns: the join holds the limit for each, not all symbols."""
    rows = table(spark, ["Common"] * 3000 + ["Commons"] * 5 + ["other", None]).drop("score", "salt")
    patterns = ["c", "co", "com", "comm", "commo", "on", "mm"]
    asked = spark.createDataFrame(list(enumerate(patterns)), "pattern_id int, pattern string")
    found = search_index(build_name_index(rows), rows, asked, "substring", 4)
    assert key(found) == key(search_names(rows, patterns, "substring", 4))
    assert "__nth" in found._jdf.queryExecution().optimizedPlan().toString()
    found.collect()
    sizes = []  # rows of the plan's joins, as they ran

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name:
            sizes.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(found._jdf.queryExecution().executedPlan())
    assert max(s for s in sizes if s != 3005) < 3000
