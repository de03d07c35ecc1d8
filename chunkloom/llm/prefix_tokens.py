"""Encoding and decoding with a merge-type SentencePiece model, by a table over prefixes.

The model's merges give a text one segmentation, and with it every prefix has one last token. The
table is filled from left to right: an automaton finds the pieces that end at a place, and of these the one
is the prefix's last token that is compatible with the last token before it, which means that the two
together segment into just these two. The segmentation is read off backwards from the end.

No piece of such a model holds a space mark after another character, so texts are cut there and each
distinct stretch is encoded once per worker. Characters without a piece become byte tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Stretches of one generation that a worker remembers, and their characters; what is beyond is computed anew.
REMEMBERED, HELD = 150_000, 4_000_000
#: Characters up to which looking at all neighbours is quicker than a heap of them.
SHORT = 24


class PieceTable:
    """Pieces, merges and ids of a model file's content."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or len(rules.precompiled_charsmap):
            raise ValueError("only merge-type models that leave characters as they are")
        if rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that keep white space and mark it")
        kinds = proto.SentencePiece
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.silent = {k for k, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.end = self.pieces.index("</s>")
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces) or any(MARK in x.lstrip(MARK) for x in self.ids):
            raise ValueError("only models without own symbols and with space marks in front")
        apart = "".join(c for c in "\n\t\r" if not any(c in x for x in self.ids))
        self.stretch = re.compile(f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+")
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.single = {x for x in self.ids if len(x) == 1}
        self.id_text = {x: str(k) for x, k in self.ids.items()}
        self.surface = {x: x.replace(MARK, " ") for x in self.ids}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.pairs_known = 0
        self.known: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """The segmentation by merging neighbours, best score first, then leftmost."""
        if len(text) > SHORT:
            return self.merged_by_heap(text)
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def merged_by_heap(self, text: str) -> list[str]:
        """The same for texts of any length: n log n steps, as a merge makes at most two new neighbours."""
        parts, scores, n = list(text), self.scores, len(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                pair = parts[k] + parts[after[k]]
                if (score := scores.get(pair)) is not None:
                    heapq.heappush(heap, (-score, k, pair))

        for k in range(n):
            offer(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            # An offer is out of date once either part was merged; a merged right part is empty.
            if not parts[k] or after[k] >= n or parts[k] + parts[after[k]] != pair:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = pair, "", after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p]

    def compatible(self, left: str, right: str) -> bool:
        """Whether ``left`` (nothing at a start) may stand before ``right``."""
        if self.pairs_known >= 4 * REMEMBERED:
            self.pairs.clear()
            self.pairs_known = 0
        self.pairs_known += 1
        found = self.merged(left + right) == ([left, right] if left else [right])
        self.pairs.setdefault(left, {})[right] = found
        return found

    def tokens(self, text: str) -> list[str]:
        """Pieces (or lone characters) of a stretch, by the prefix table."""
        if not text.strip(MARK):  # all pieces of marks have one score: merging order decides
            return self.merged(text)
        last: list[str | None] = [""] + [None] * len(text)
        if self.single.issuperset(text):
            ending = self.automaton.iter(text)
        else:  # a character without a piece is its own token
            lone = [(at, (c, 1)) for at, c in enumerate(text) if c not in self.ids]
            ending = sorted([*self.automaton.iter(text), *lone], key=lambda x: (x[0], -x[1][1]))
        pairs = self.pairs
        for at, (piece, size) in ending:  # ends ascend; of one end, longer pieces come first
            if last[at + 1] is not None or (before := last[at + 1 - size]) is None:
                continue
            known = pairs.get(before)
            fits = None if known is None else known.get(piece)
            if self.compatible(before, piece) if fits is None else fits:
                last[at + 1] = piece
        out, at = [], len(text)
        while at:
            piece = last[at]
            if piece is None:  # no compatible piece: not a prefix that merging can leave
                return self.merged(text)
            out.append(piece)
            at -= len(piece)
        out.reverse()
        return out

    def ids_of(self, tokens: Sequence[str]) -> list[int]:
        out: list[int] = []
        for token in tokens:
            if (found := self.ids.get(token)) is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def stretches(self, text: str) -> list[str]:
        return self.stretch.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def encode(self, text: str, end: bool = True) -> list[int]:
        out = [k for part in self.stretches(text) for k in self.ids_of(self.tokens(part))]
        return [*out, self.end] if end else out

    def decode(self, ids: Sequence[int], start: bool = True) -> str:
        """The text of ids; at a ``start``, without the mark that the model puts first."""
        out, held = [], bytearray()
        for k in [*ids, None]:
            if k in self.byte_of:
                held.append(self.byte_of[k])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if k is not None and k not in self.silent:
                out.append(" ⁇ " if k == self.unknown else self.pieces[k])
                if start and self.prefix:
                    out[-1] = out[-1].removeprefix(self.prefix)
            start = start and not out
        return "".join(out).replace(MARK, " ")

    def told(self, part: str) -> tuple[str, int, str]:
        """A stretch's ids as text, their number, and what they decode to inside a text.

        Two generations are kept: a full one becomes the old one, from which what is used again comes back.
        """
        if (found := self.old.get(part)) is None:
            tokens = self.tokens(part)
            try:
                found = " ".join([self.id_text[t] for t in tokens]), len(tokens), "".join([self.surface[t] for t in tokens])
            except KeyError:
                ids = self.ids_of(tokens)
                found = " ".join(map(str, ids)), len(ids), self.decode(ids, start=False)
        if len(self.known) >= REMEMBERED or self.held >= HELD:
            self.old, self.known, self.held = self.known, {}, 0
        self.known[part] = found
        self.held += len(part)
        return found

    def whole(self, text: str) -> tuple[str, int, str]:
        """Ids as text, their number and the decoded text of a whole text, with an end id."""
        parts = self.stretches(text)
        if not parts:
            return str(self.end), 1, ""
        get = self.known.get
        found = [get(part) or self.told(part) for part in parts]
        ids, counts, decoded = zip(*found, strict=True)
        text = "".join(decoded)
        if self.prefix:
            text = text.removeprefix(" ")
        return f"{' '.join(ids)} {self.end}", sum(counts) + 1, text


_tables: dict[bytes, PieceTable] = {}


def table(model: bytes) -> PieceTable:
    """The table of a model, built once per worker."""
    key = hashlib.md5(model).digest()
    if key not in _tables:
        _tables.clear()
        _tables[key] = PieceTable(model)
    return _tables[key]


def _per_text(docs: DataFrame, model_file: str, text: str, keep: Sequence[str], added: list[T.StructField], make: Callable) -> DataFrame:
    with open(model_file, "rb") as file:  # a local file of the driver's
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [c for c in keep if c not in {f.name for f in added}]
    width = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = table(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [make(pieces, x.as_py() or "") for x in part.column(width)]
                columns = [pa.array([r[k] for r in rows], pa.string() if f.dataType == T.StringType() else pa.int64() if f.dataType == T.LongType() else pa.list_(pa.int32())) for k, f in enumerate(added)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(width)] + columns, names=[*names, *(f.name for f in added)])

    source = docs.select(*names, docs[text].alias("text to encode"))
    return source.mapInArrow(run, T.StructType(docs.select(*names).schema.fields + added))


def encoded(docs: DataFrame, model_file: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) and ``ids`` (array), with an end id, and ``decoded``.

    A null or empty text has the end id only and decodes to an empty text. Rows are independent; an
    empty table gives none. Columns of ``docs`` named like an added one are replaced.
    """
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make(pieces: PieceTable, value: str) -> tuple:
        ids, _, decoded = pieces.whole(value)
        return [int(k) for k in ids.split(" ")], decoded

    return _per_text(docs, model_file, text, docs.columns if keep is None else keep, added, make)


def token_digests(docs: DataFrame, model_file: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """As ``encoded``, with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` instead of the lists and texts."""
    added = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def make(pieces: PieceTable, value: str) -> tuple:
        ids, n, decoded = pieces.whole(value)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _per_text(docs, model_file, text, keep, added, make)
