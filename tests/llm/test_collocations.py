"""Collocations against counting every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest
from compare import compare, connect

from chunkloom.llm.collocations import COLLOCATION_SQL, CollocationParams, collocations, phrase_counts, prefix_bits, scored


def by_hand(docs, p):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    out = set()
    for lang, counts in f.items():
        inside = Counter()
        for phrase, a in counts.items():
            if len(phrase) == 3 and a >= p.least:
                for part in (phrase[:2], phrase[1:]):
                    inside[part] = max(inside[part], a)
        rows = []
        for phrase, a in counts.items():
            if len(phrase) > 1 and a >= p.least and not (len(phrase) == 2 and 100 * inside[phrase] >= 50 * a):
                cuts = [(10**6 * a * a // (counts[phrase[:k]] * counts[phrase[k:]]), k) for k in range(1, len(phrase))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[: p.top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return out


def check(spark, rows, p):
    docs = spark.createDataFrame(rows, "lang string, text string, phrase string").repartition(3)
    got = [tuple(r) for r in collocations(docs, p).collect()]
    assert len(got) == len(set(got))
    assert set(got) == by_hand([r[:2] for r in rows], p)
    return got


@pytest.mark.parametrize("p", [CollocationParams(least=3, top=5, ahead=1, growth=2), CollocationParams(least=2, top=40), CollocationParams(least=2, top=100_000)])
def test_against_counting(spark, p):
    draw = random.Random(p.top)
    words = ["The", "of", "Ünï", "été", "don't", "x", "data", "base", "中文", "new", "york", "city"]
    rows = []
    for k in range(60):
        text = ""
        for _ in range(draw.randint(0, 80)):
            text += draw.choice(["new york city", "data base", *words, *words]) + draw.choice([" ", " ", " \t", ", ", "\n", "."])
        rows.append((draw.choice(["en", "en", "en", "de", None]), text, "p"))
    assert check(spark, rows, p)


def test_drops_need_prefixes_below_the_threshold(spark):
    # "b c" scores best and lies inside "a b c", whose prefix "a b" has a low bound.
    rows = [("en", "a b c. " * 20 + "a z. " * 900 + "q b. " * 3 + "k l. " * 11 + "k m. l m. " * 3, None)]
    got = check(spark, rows, CollocationParams(least=10, top=1, ahead=1, growth=2))
    assert got[0][2] != "b c"


def test_odd_rows(spark):
    p = CollocationParams(least=2, top=10)
    same = ("en", "one two three four. " * 50, None)
    rows = [(None, None, None), ("en", "", None), ("fr", " .,;\n", None), same, same, ("xx", "solo", None), (None, "a b a b a b " * 30_000, "w")]
    check(spark, rows, p)
    assert check(spark, [], p) == []


def test_the_map_of_prefixes_keeps_what_is_marked(spark):
    docs = spark.createDataFrame([("en", "a b c a b d. b c a"), ("de", "a b c")], "lang string, text string")
    bits = prefix_bits(spark.createDataFrame([("en", "a b")], "lang string, phrase string"))
    got = {(r.lang, r.phrase, r.n) for r in phrase_counts(docs, (3,), 1, bits, head=2).where("phrase <> ''").collect()}
    assert got == {("en", "a b c", 1), ("en", "a b d", 1)}


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    parts = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 7)], "lang string, phrase string, n long")
    row = scored(spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, n long"), parts, 1).first()
    assert row.score == 10**6 * big * big // ((big + 1) * (big + 7))


def test_whole_table_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    diff, count, _ = compare(spark, connect(sf), sf, "op12", lambda s, d: collocations(s.read.parquet(f"{d}/documents.parquet")), COLLOCATION_SQL)
    assert diff == "" and count > 1000
