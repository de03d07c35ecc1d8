"""Ids and decoded texts against the library."""

import random

import pytest
import sentencepiece

from chunkloom.llm import prefix_tokens
from chunkloom.llm.prefix_tokens import PieceTable, encoded, token_digests
from chunkloom.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def pieces():
    with open(piece_model(), "rb") as file:
        return PieceTable(file.read())


ODD = [
    "", " ", "  ", "   a", "a ", "\n", "a\n b", "\ta", "日本語 テスト", "a▁b", "<s> </s>", "é" * 20, "\x00a", "  \n  x", " " * 33 + "x", " " * 50,
    "🙂 x🙂🙂", "a" * 200, "▁", "⁇", "the" * 50, "� x", "﻿a", "éa", "ﬁ ① ｱ", "\r\n\x0b\x0c",
]


def same(pieces, library, text):
    ids = library.encode(text, add_eos=True)
    assert pieces.encode(text) == ids, text
    told = pieces.whole(text)
    assert told == (" ".join(map(str, ids)), len(ids), library.decode(ids)), text
    assert pieces.decode(ids) == library.decode(ids), text


def test_odd_texts(pieces, library):
    for text in ODD:
        same(pieces, library, text)


def test_random_texts(pieces, library, monkeypatch):
    monkeypatch.setattr(prefix_tokens, "REMEMBERED", 50)  # generations turn over often
    draw = random.Random(2)
    letters = "abcdehinorst  \n.,éüßñ日🙂ABTH!0123456789—-_▁"
    for _ in range(3000):
        same(pieces, library, "".join(draw.choice(letters) for _ in range(draw.randrange(1, 30))))
    parts = [" the", " in", " ", "  ", "tion", "and", "er", "!!!", "==", "//", "    "]
    for _ in range(1000):
        same(pieces, library, "".join(draw.choice(parts) for _ in range(draw.randrange(1, 12))))


def test_prefix_table_gives_what_merging_gives(pieces):
    draw = random.Random(4)
    for _ in range(400):
        text = "▁" + "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(1, 14)))
        assert pieces.tokens(text) == pieces.merged(text)


def test_long_runs(pieces, library):
    for text in [*(" " * n + end for n in range(1, 200) for end in ("", "x")), " " * 100_000, "▁" * 99_999 + "\n", "a" + "  b" * 40_000]:
        ids = library.encode(text, add_eos=True)
        assert pieces.encode(text) == ids and pieces.whole(text)[2] == library.decode(ids), len(text)
    draw = random.Random(6)
    for size in (40, 500, 20_000):
        for letters in ("▁ etaoin", "=-", "日本語🙂", "qzxj", "ab▁"):
            text = "".join(draw.choice(letters) for _ in range(size))
            assert pieces.encode(text) == library.encode(text, add_eos=True)


def test_heap_merges_like_looking_at_all_neighbours(pieces, monkeypatch):
    monkeypatch.setattr(prefix_tokens, "SHORT", 10**9)
    draw = random.Random(8)
    for _ in range(1500):
        text = "".join(draw.choice("etaoinshr▁▁= 日") for _ in range(draw.randrange(0, 40)))
        assert pieces.merged_by_heap(text) == pieces.merged(text)


def test_memory_is_bounded_by_characters(pieces, library, monkeypatch):
    monkeypatch.setattr(prefix_tokens, "HELD", 1000)
    pieces.known, pieces.old, pieces.held = {}, {}, 0
    for k in range(40):
        same(pieces, library, f"{k}" + "ab" * 300)
        assert sum(map(len, pieces.known)) <= 1000 + 700 and sum(map(len, pieces.old)) <= 1000 + 700


def test_table(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in encoded(rows, piece_model()).collect()}
    for r in rows.collect():
        assert got[r.doc_id].ids == library.encode(r.text, add_eos=True)
        assert got[r.doc_id].decoded == r.text


def test_nulls_long_texts_and_clashing_columns(spark, library):
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (3, "a word " * 30_000, 5)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, ids int")
    got = sorted(encoded(frame, piece_model(), keep=["doc_id", "ids"]).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in got[:3]] == [[2], [2], [2]]
    assert got[3].ids == library.encode(rows[3][1], add_eos=True)
    assert token_digests(frame.where("false"), piece_model()).count() == 0
    assert token_digests(frame, piece_model()).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
