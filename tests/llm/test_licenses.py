"""License spans against plain loops."""

import random
import re

import pytest

from chunkloom.llm.license_scan import BASE, NOTICES, ScanParams, license_labels, license_spans, license_templates

BSD = NOTICES[4][1]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(text, p):
    """(n_words, n_base, first, last, base labels, labels, score) by trying every template at every place."""
    words, base, found, score = words_of(text), [], set(), 0.0
    for label, phrase in BASE:
        want = phrase.split()
        base += [(k, label) for k in range(len(words) - len(want) + 1) if words[k : k + len(want)] == want]
    for label, notice in NOTICES:
        want = notice.split()
        voted = {}
        for i in range(len(words) - p.words + 1):
            for j in range(len(want) - p.words + 1):
                if words[i : i + p.words] == want[j : j + p.words]:
                    voted.setdefault(i - j, set()).add(j)
        spans = []
        for d in sorted(voted):
            if spans and len(want) > p.short and d - spans[-1][-1][0] <= p.drift:
                spans[-1].append((d, voted[d]))
            else:
                spans.append([(d, voted[d])])
        for span in spans:
            covered = {j + k for _, js in span for j in js for k in range(p.words)}
            first, end = min(d + min(js) for d, js in span), max(d + max(js) for d, js in span) + p.words
            if len(covered) >= (1 if len(want) <= p.short else p.share) * len(want) and len(covered) >= p.dense * (end - first):
                found.add(label)
                score = max(score, len(covered) / len(want))
    starts = [k for k, _ in base]
    named = {x for _, x in base}
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(named)),
        ",".join(sorted(named | found)), max(score, float(bool(base))),
    )


def check(spark, rows, p=ScanParams()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(3)
    got = sorted((tuple(r) for r in license_labels(docs, license_templates(spark), p).collect()), key=repr)
    assert got == sorted(((*row, *by_hand(row[1], p)) for row in rows), key=repr)
    return got


@pytest.mark.parametrize("p", [ScanParams(), ScanParams(share=0.5, dense=0.4, drift=4, short=5, block=7)])
def test_mutated_notices(spark, p):
    draw = random.Random(5)
    rows = []
    for k in range(120):
        words = [f"w{draw.randint(0, 30)}" for _ in range(draw.randint(0, 30))]
        for _ in range(draw.randint(0, 3)):
            passage = draw.choice([*BASE, *BASE, *NOTICES])[1].upper().split()
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(passage))
                passage[at : at + draw.choice([0, 1])] = draw.choice([[], ["of"], ["very", "odd"]])
            at = draw.randint(0, len(words))
            words[at:at] = passage
        rows.append((k, draw.choice([" ", "-", ", ", "\n"]).join(words), None))
    got = check(spark, rows, p)
    assert any(r[8] and r[8] != r[7] for r in got)


def test_odd_rows(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, None, "a"), (None, "", None), (2, mit, None), (2, mit, None), (3, (mit + " ") * 4000, None), (4, "cc by nc cc by nc, cc-by-nc" * 2, None),
        (5, "apache license version", None), (6, "Apache License, Version 2.0", None), (7, "cc by", None), (8, "x" * 200_000 + " cc by nc", None),
        (9, "under under the mit license é中", None), (10, "apache license version 3", None),
    ]
    check(spark, rows)
    assert check(spark, []) == []


def test_gpl_line_gets_a_label_of_the_method(spark):
    rows = [(1, "This work is licensed under the GNU General Public License, version 3.", None)]
    assert check(spark, rows)[0][-3:] == ("", "gpl-3", 1.0)


def test_one_word_more_is_another_license(spark):
    text = "Licensed under a Creative Commons Attribution-{} 4.0 International License"
    rows = [(1, text.format("ShareAlike"), None), (2, "licensed under the GNU Lesser General Public License version 3", None)]
    assert [r[-2] for r in check(spark, rows)] == ["cc-by-sa", "lgpl-3"]


def test_spans(spark):
    docs = spark.createDataFrame([("a b " + BSD.replace("binary", "big binary") + " c",)], "text string")
    (row,) = license_spans(docs, license_templates(spark), ScanParams()).collect()
    assert (row.label, row.first_word, row.end_word) == ("bsd", 2, 2 + len(BSD.split()) + 1)


def test_whole_table_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source")
    check(spark, [tuple(r) for r in docs.collect()])
