"""Every stage of the pipeline and its whole result against plain Python over the same rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_mix import walk
from test_near import by_hand as components_by_hand
from test_quality import WORD
from test_quality import by_hand as counts_by_hand

import corpus_pipeline
from chunkloom.llm.circulant import NearParams
from chunkloom.llm.line_quality import LineLimits
from chunkloom.llm.queries import piece_model
from chunkloom.session import materialize

SF = "/root/testdata/sf0.001"


def normal(line):
    return tuple(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))


def quality(rows, p=LineLimits()):
    """Rows (doc_id, text, source) that pass, without the lines of too many different documents of their host."""
    sets = [frozenset(normal(x) for x in (text or "").split("\n") if WORD.search(x)) for _, text, _ in rows]
    hosts, holders = defaultdict(set), defaultdict(set)
    for (_, _, host), own in zip(rows, sets, strict=True):
        hosts[host].add(own)
        for line in own:
            holders[host, line].add(own)
    out = []
    for doc_id, text, host in rows:
        parts = re.findall(r"[^\n]*\n|[^\n]+", text or "")
        limit = max(p.min_docs - 1, p.share * len(hosts[host]))
        gone = [bool(normal(x)) and len(holders[host, normal(x)]) > limit for x in parts]
        n_words, _, _, _, repeated = counts_by_hand(text)
        left = n_words - sum(len(normal(x)) for x, g in zip(parts, gone, strict=True) if g)
        if n_words >= 20 and 100 * repeated <= 30 * n_words and left >= p.min_words and left >= p.keep_share * n_words:
            out.append((doc_id, "".join(x for x, g in zip(parts, gone, strict=True) if not g), host))
    return out


def near_dedup(rows):
    part = components_by_hand([(i, text) for i, text, _ in rows], NearParams(words=5, percent=80))
    return [r for r in rows if part[r[0]] == r[0]]


def repeats(rows, width=50):
    first, out = {}, []
    for i, text, _ in sorted(rows):
        raw = text.encode()
        for k in range(len(raw) - width + 1):
            first.setdefault(raw[k : k + width], i)
    for i, text, source in rows:
        raw, kept = text.encode(), bytearray(b"\1") * len(text.encode())
        for k in range(len(raw) - width + 1):
            if first[raw[k : k + width]] < i:
                kept[k : k + width] = bytes(width)
        out.append((i, bytes(b for b, k in zip(raw, kept, strict=True) if k).decode("utf-8", "ignore"), source))
    return out


def mix(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.xxhash64("doc_id", "text"))
    rows = frame.withColumn("size", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).collect()
    out = []
    for r, taken in zip(rows, walk(rows), strict=True):
        if taken:
            whole, rest = divmod(taken, r["size"])
            out += [(r.doc_id, r.text, r.source)] * whole + [(r.doc_id, " ".join(WORD.findall(r.text)[:rest]), r.source)] * bool(rest)
    return out


def digests(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    out = []
    for i, text, _ in rows:
        ids = library.encode(text, add_eos=True)
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        out.append((i, len(ids), *sums))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """The table, beside copies, near copies, a line that a host repeats, a shared passage and odd texts."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    boiler, passage = "All Rights reserved by the makers of these pages", words("shared", 60)
    more = [(10**6 + k, f"{boiler.upper() if k % 2 else boiler}\n{words(k, 30)}\n\n tail é{k}", "en", "host", 0) for k in range(45)]
    more += [(2 * 10**6 + k, f"{words(k + 100, 30)} {passage} {words(k + 200, 25)}", "en", ["host", None][k % 2], 0) for k in range(12)]
    more += [(3 * 10**6 + k, words(300, 100) + f" end{k}", "en", "copies", 0) for k in range(10)]
    more += [(4 * 10**6, None, None, None, None), (4 * 10**6 + 1, "", "en", "host", 0), (4 * 10**6 + 2, "a b " * 50, "en", "host", 0)]
    more += [(4 * 10**6 + 3, "only " + words(7, 24), "en", "tiny", 0), (4 * 10**6 + 4, f"{boiler}\nfew words left", "en", "host", 0)]
    return materialize(frame.unionByName(spark.createDataFrame(more, frame.schema)), "planted")


def test_stages_and_result(spark, docs):
    plain = lambda frame: [(r.doc_id, r.text, r.source) for r in frame.collect()]
    wanted = [quality, near_dedup, repeats, lambda rows: mix(spark, rows)]
    rows, own = docs, plain(docs)
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, wanted, strict=False):
        rows, own = materialize(stage(spark, rows, SF), "stage"), by_hand(own)
        assert Counter(plain(rows)) == Counter(own), name
        assert rows.columns == docs.columns
        assert all(r.n_chars == len(r.text) for r in rows.collect())
    name, stage = corpus_pipeline.STAGES[-1]
    assert Counter(map(tuple, stage(spark, rows, SF).collect())) == Counter(digests(own))
    left = {i for i, _, _ in own}
    assert 3 * 10**6 in left and not left & {3 * 10**6 + 1, 4 * 10**6, 4 * 10**6 + 1, 4 * 10**6 + 2}
    assert not any("makers of these pages" in text.lower() for _, text, _ in own)
    assert {i for i, text, _ in own if "wsharedx30" in text} == {2 * 10**6}
