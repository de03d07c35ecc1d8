"""Rule sets, matching and rule texts."""

import pytest
from conftest import rows

from chunkloom.operators import rules
from chunkloom.operators.segments import SEGMENT_LINES
from chunkloom.sources.rules import Rule, Ruleset, load_rules, parse_rules

SHAPE = "symbol_id long, path string, name string, kind string, code string, start_line long"


def rule(kind=(".*",), name=(".*",), path=("**",), code=(".*",), texts=("T",)):
    return Rule(tuple(kind), tuple(name), tuple(path), tuple(code), tuple(texts))


def table(spark):
    return spark.createDataFrame(
        [
            (1, "/src/a.rs", "Alpha", "Struct", "struct Alpha;", 0),
            (2, "/src/b/c.rs", "beta", "Function", "fn beta() {\n  unsafe {}\n}", 4),
            (3, "/src/a.rs", "Gamma", "Struct", None, 9),
        ],
        SHAPE,
    )


@pytest.mark.parametrize(
    "one,want",
    [
        (rule(), [1, 2]),  # no code, no match
        (rule(kind=("^S", "Enum")), [1]),
        (rule(name=("^b",)), [2]),
        (rule(path=("/src/*.rs",)), [1]),
        (rule(path=("**/*.{rs,kt}",), code=("unsafe",)), [2]),
        (rule(kind=()), []),
        (rule(path=()), []),
        (rule(code=()), []),
    ],
)
def test_matching(spark, one, want):
    got = rules.match_rules(table(spark), Ruleset((), (one,)))
    assert [r[0] for r in rows(got, "symbol_id")] == want


def test_rules_are_known_by_position(spark):
    twins = Ruleset((), (rule(kind=()), rule(texts=("one",)), rule(texts=("two", "three"))))
    assert rows(rules.match_rules(table(spark), twins), "rule_pos", "symbol_id") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows(rules.rules_for_request(table(spark), twins)) == [(1, "one"), (2, "two"), (3, "three")]
    assert rules.match_rules(table(spark), Ruleset()).count() == 0


def test_templates():
    loop = "A {%for s in symbols%}<{{ s.name }}:{{s.kind}}{% if not loop.last %};{% endif %}>{% endfor %} B"
    assert rules.template_pieces(loop) == [
        ("text", "A "),
        ("each", ["<", ("name",), ":", ("kind",)], ";", ">"),
        ("text", " B"),
    ]
    assert rules.template_pieces("{symbols} and {symbols.path}!") == [
        ("each", [("name",)], ", ", ""),
        ("text", " and "),
        ("each", [("path",)], ", ", ""),
        ("text", "!"),
    ]
    for bad in ("{% if x %}y{% endif %}", "{{ symbols }}", "{symbols.size}", "{% for s in symbols %}{{ s.name | upper }}{% endfor %}"):
        with pytest.raises(ValueError):
            rules.template_pieces(bad)


def test_texts_over_files_and_segments(spark):
    """Parts joined in order are the text over all symbols, separators included."""
    many = [(i, f"/f{i % 3}", f"n{i}&", "Struct", "x", (i * 977) % (3 * SEGMENT_LINES)) for i in range(60)]
    ruleset = Ruleset((), (rule(texts=("[{% for s in symbols %}({{ s.name }}{% if not loop.last %}, {% endif %}){% endfor %}]",)),))
    frame = spark.createDataFrame(many, SHAPE)
    parts = rules.rule_text_parts(rules.match_rules(frame, ruleset), ruleset).collect()
    ordered = sorted(parts, key=lambda r: (r.rule_pos, r.template_pos, r.piece, r.path, r.segment))
    names = [f"n{m[0]}&amp;" for m in sorted(many, key=lambda m: (m[1], m[5], m[0]))]
    want = "[" + "".join(f"({n}{', ' if i < len(names) - 1 else ''})" for i, n in enumerate(names)) + "]"
    assert "".join(r.text for r in ordered) == want
    assert len(parts) > 5
    assert rows(rules.rules_for_request(frame, ruleset)) == [(0, want)]


def test_loading(tmp_path):
    file = tmp_path / "rules.yml"
    file.write_text("common: [a]\ndepends_on:\n  - {kind: ['S'], name: ['.*'], path: ['**'], code: ['.*'], rules: ['r']}\n")
    got = load_rules(file)
    assert got.common == ("a",) and got.depends_on[0].rules == ("r",)
    for bad in ("common: [", "common: [a]", "common: [a]\ndepends_on: [{kind: ['(']}]"):
        file.write_text(bad)
        with pytest.raises(ValueError):
            load_rules(file)
    with pytest.raises(OSError):
        load_rules(tmp_path / "none.yml")
    with pytest.raises(ValueError):
        parse_rules({"common": [], "depends_on": [dict(kind=["("], name=[], path=[], code=[], rules=[])]})
    with pytest.raises(ValueError):
        parse_rules({"common": [1], "depends_on": []})
