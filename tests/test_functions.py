"""Column functions on small literals."""

import os
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chunkloom.functions import kinds, paths, patterns, text


def column(spark, values, fn, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in frame.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "glob,yes,no",
    [
        ("**/*.rs", ["a.rs", "x/a.rs", "x/y/a.rs"], ["a.rsx", "a.c"]),
        ("*.rs", ["a.rs"], ["x/a.rs"]),
        ("/src/**", ["/src/a", "/src/a/b"], ["/src2/a", "/src"]),
        ("**/*.{rs,kt,c}", ["a.kt", "x/b.c"], ["a.k", "a.rs.bak"]),
        ("a?c", ["abc"], ["a/c", "ac"]),
        ("[!a]x", ["bx"], ["ax"]),
        ("[ab]x", ["ax"], ["cx"]),
        ("a.b+(c)", ["a.b+(c)"], ["aXb+(c)"]),
        ("**", ["", "a/b"], []),
    ],
)
def test_globs(spark, glob, yes, no):
    assert column(spark, yes + no, lambda c: patterns.glob_match(c, [glob])) == [True] * len(yes) + [False] * len(no)


def test_glob_list_and_errors(spark):
    assert column(spark, ["a", None], lambda c: patterns.glob_match(c, [])) == [False, False]
    with pytest.raises(ValueError):
        patterns.glob_to_regex("{a,b")


def test_regex_lists(spark):
    assert column(spark, ["Struct", "Enum", None], lambda c: patterns.any_regex(c, ["ruc", "^X"])) == [True, False, False]
    assert column(spark, ["Struct"], lambda c: patterns.any_regex(c, [])) == [False]
    for bad in ("(", "a(?=b)", "a++", r"(a)\1"):
        with pytest.raises(ValueError):
            patterns.check_regex(bad)


def test_uris(spark):
    uris = ["file:///a/b%20c.rs", "file://localhost/x", "file://host/x", "http://a/b", "/a", "file:///a+b", None]
    assert column(spark, uris, paths.uri_to_path) == ["/a/b c.rs", "/x", None, None, None, "/a+b", None]
    names = ["/a b/ü+c.rs", "/x%y", "rel"]
    assert column(spark, names, lambda c: paths.uri_to_path(paths.path_to_uri(c))) == ["/a b/ü+c.rs", "/x%y", None]


def test_parents_and_absolute(spark):
    assert column(spark, ["/a/b", "/a", "/", "a/b"], paths.parent_path) == ["/a", "/", None, "a"]
    assert column(spark, ["/a", "b/c"], lambda c: paths.absolute_path(F.lit("/r/"), c)) == ["/a", "/r/b/c"]


def test_path_distance(spark):
    rnd = random.Random(5)
    pairs = [("/a/b/c.rs", "/a/x/d.rs"), ("/a", "/a"), ("/a/b", "/a"), ("/", "/a/b")]
    pairs += [
        tuple("/" + "/".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) for _ in range(2)) for _ in range(50)
    ]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", paths.path_distance(F.col("a"), F.col("b")).alias("d")).collect():
        a, b = [p for p in r.a.split("/") if p], [p for p in r.b.split("/") if p]
        common = len(os.path.commonprefix([a, b]))
        assert r.d == len(a) + len(b) - 2 * common, r


def test_prefixes(spark):
    assert column(spark, ["/a/b", "/"], paths.prefixes) == [["", "/a", "/a/b"], [""]]


def test_kinds(spark):
    assert column(spark, [1, 5, 26, 27, 0, None], kinds.kind_name, "int") == ["File", "Class", "TypeParameter", None, None, None]
    assert column(spark, ["Struct", "Nope", None], kinds.kind_code) == [23, None, None]


def test_text(spark):
    assert column(spark, ["<a b='c'>&amp;/\""], text.html_escape) == ["&lt;a b=&#x27;c&#x27;&gt;&amp;amp;&#x2F;&quot;"]
    assert column(spark, ["x", "", None], text.or_default) == ["x", "(none)", "(none)"]


def test_hover_variants(spark):
    marked = "struct<language:string,value:string>"
    data = [
        (1, ((None, "plain"), None, None)),
        (2, (("rust", "fn a()"), None, None)),
        (3, (None, [(None, "one"), ("rust", "two")], None)),
        (4, (None, None, "**md**")),
        (5, None),
    ]
    frame = spark.createDataFrame(data, f"i int, hover struct<scalar:{marked},parts:array<{marked}>,markup:string>")
    assert rows(frame.select("i", text.hover_text(F.col("hover")))) == [
        (1, "plain"),
        (2, "fn a()"),
        (3, "one\ntwo"),
        (4, "**md**"),
        (5, None),
    ]
