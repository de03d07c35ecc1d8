"""Repeated passages: maximal repeats of whole texts from sparse enhanced suffix arrays.

A text is cut into pieces at content-defined anchors: of the ``GRAM``-byte strings in a window of
``width`` bytes, the leftmost with the least hash is the window's anchor. Windows with one anchor
in a row form a piece (at most ``2 * width - GRAM`` bytes), so equal windows always lie in pieces
with equal anchors, wherever they occur. That gives the distribution:

1. The pieces' anchors and hashes are packed into rows per bucket of anchors. Pieces equal to one of
   a smaller document in the same batch are settled before the shuffle.
2. A bucket settles equal pieces of different batches and asks for the bytes of the pieces that
   share an anchor with a *different* piece of another document.
3. Over those bytes a bucket builds an enhanced suffix array of the window starts that occur in
   two documents, scans its common-prefix intervals with a stack and keeps those whose
   occurrences have different left neighbours (or reach a piece's edge): the maximal repeats, with
   all their occurrences. Each occurrence takes its deepest interval that holds a smaller document.
4. The spans come back to the texts, where neighbouring ones melt into one.

Texts meet their spans by a part number, a hash of the row; no step gathers a document group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chunkloom.llm.text import BLOCK, blocks, mix, powers, prefix_hashes, span_hashes
from chunkloom.session import materialize

GRAM = 16
#: Bytes of text per bucket of anchors and per part of texts; pieces held before they are packed.
SHARE = 6 << 20
HELD = 1 << 20
LAST = np.int64(2**63 - 1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one binary value; ``unpack`` needs their types."""
    sizes = np.array([len(x) for x in arrays], dtype=np.int64)
    return sizes.tobytes() + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)


def unpack(raw: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], sizes.nbytes
    for kind, n in zip(types, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


def gathered(column: pa.ChunkedArray, *types: str) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """The unpacked arrays of all rows, joined, and row by row."""
    rows = [unpack(x.as_py(), *types) for x in column if x.is_valid]
    return [np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, t) for k, t in enumerate(types)], rows


def pieces(data: np.ndarray, offsets: np.ndarray, width: int):
    """Pieces of a block of texts: (text number, start in the block, windows, anchor hash, piece hash)."""
    n, window = len(data), width - GRAM + 1
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = prefix_hashes(data)
    _, down = powers(n + 1)
    raw = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    best = raw * np.uint64(0x9FB21C651E98DF25)
    best &= np.uint64(0xFFFFFFFF00000000)
    best |= np.arange(len(raw), dtype=np.uint64)
    reach = 1
    while reach * 2 <= window:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if window > reach:
        best = np.minimum(best[: reach - window], best[window - reach :])
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(best)]
    at = np.flatnonzero(ends - np.arange(len(best)) >= width)
    anchor = (best[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(at) else at
    start, count = at[first], np.diff(np.append(first, len(at)))
    owner = np.searchsorted(offsets, start, side="right") - 1
    return owner, start, count, mix(raw[anchor[first]]), span_hashes(sums, start, start + count + width - 1)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the last key, then the one before it, and so on; first flags without the first key."""
    order = np.lexsort(keys)
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys[1:]], axis=0)
    return order, fresh


class _Held:
    """Pieces waiting to be packed, with the rows (uid, rank of the document) they belong to."""

    def __init__(self) -> None:
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.texts = self.size = 0

    def add(self, uid, rank, owner, start, count, anchor, piece) -> None:
        self.rows.append((uid, rank))
        self.parts.append((owner + self.texts, start, count, anchor, piece))
        self.texts += len(uid)
        self.size += len(start) + len(uid) // 8

    def flush(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        uid, rank = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        owner, start, count, anchor, piece = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.__init__()
        order, fresh = _groups(rank[owner], mix(anchor ^ (piece * np.uint64(0xD6E8FEB86659FD93))))
        least = rank[owner][order][fresh][np.cumsum(fresh) - 1]
        settled = np.zeros(len(order), dtype=bool)
        settled[order] = rank[owner][order] > least
        bucket = ((anchor >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint32)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(bucket[order].astype(np.int64)) != 0)) if len(order) else order
        out: tuple[list, list] = ([], [])
        for part in np.split(order, cuts[1:]) if len(order) else []:
            held, at = np.unique(owner[part], return_inverse=True)
            done = settled[part]
            open_ = part[~done]
            out[0].append(int(bucket[part[0]]))
            out[1].append(
                pack(
                    uid[held], rank[held], anchor[open_].astype(np.uint32), piece[open_], at[~done].astype(np.uint32),
                    start[open_].astype(np.uint32), count[open_].astype(np.uint8),
                    at[done].astype(np.uint32), start[part[done]].astype(np.uint32), count[part[done]].astype(np.uint8),
                )
            )
            if len(out[0]) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "load"])
                out = ([], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["bucket", "load"])


LOAD = ("i8", "i8", "u4", "u8", "u4", "u4", "u1", "u4", "u4", "u1")
SPANS = ("i8", "u4", "u4")
ASKED = ("i8", "i8", "u4", "u4", "u1")


def _by_part(parts: int, bucket: int, spans: list[np.ndarray], asked: list[np.ndarray]) -> pa.Table:
    """Rows (part, bucket, spans, asked) of a bucket's findings; both start with the rows' uid."""
    sides = []
    for arrays in (spans, asked):
        part = np.mod(arrays[0], parts)
        order = np.lexsort((arrays[0], part)) if len(part) else part
        keys, first = np.unique(part[order], return_index=True)
        cut = [np.split(x[order], first[1:]) for x in arrays]
        sides.append({int(k): pack(*(x[i] for x in cut)) for i, k in enumerate(keys)})
    keys = sorted(set(sides[0]) | set(sides[1]))
    return pa.table(
        {
            "part": pa.array(keys, pa.int32()),
            "bucket": pa.array([bucket] * len(keys), pa.int32()),
            "spans": pa.array([sides[0].get(k) for k in keys], pa.binary()),
            "asked": pa.array([sides[1].get(k) for k in keys], pa.binary()),
        }
    )


FOUND = "part int, bucket int, spans binary, asked binary"


def _settle(table: pa.Table, parts: int, width: int) -> pa.Table:
    """Equal pieces of a bucket, and what must be compared byte by byte."""
    _, rows = gathered(table.column("load"), *LOAD)
    base = np.append(0, np.cumsum([len(r[0]) for r in rows]))[:-1]
    uid, rank, anchor, piece = (np.concatenate([r[k] for r in rows]) for k in (0, 1, 2, 3))
    owner, done = (np.concatenate([r[k].astype(np.int64) + b for r, b in zip(rows, base, strict=True)]) for k in (4, 7))
    start, count, done_start, done_count = (np.concatenate([r[k] for r in rows]) for k in (5, 6, 8, 9))
    order, fresh = _groups(rank[owner], piece, anchor)
    owner, start, count, anchor = owner[order], start[order], count[order], anchor[order]
    group = np.cumsum(fresh) - 1
    gone = rank[owner] > rank[owner][fresh][group]

    of_anchor = anchor[fresh]
    lead = np.append(True, of_anchor[1:] != of_anchor[:-1])[: len(of_anchor)]
    family = np.cumsum(lead) - 1
    least = rank[owner][fresh]
    low, high = np.full(lead.sum(), LAST), np.full(lead.sum(), -LAST - 1)
    np.minimum.at(low, family, least)
    np.maximum.at(high, family, least)
    wanted = (low < high)[family][group] & ~gone
    ends = start.astype(np.int64) + count + width - 1
    done_ends = done_start.astype(np.int64) + done_count + width - 1
    spans = [
        np.concatenate([uid[owner[gone]], uid[done]]),
        np.concatenate([start[gone], done_start]),
        np.concatenate([ends[gone], done_ends]).astype(np.uint32),
    ]
    asked = [uid[owner[wanted]], rank[owner[wanted]], anchor[wanted], start[wanted], count[wanted]]
    return _by_part(parts, table.column("bucket")[0].as_py(), spans, asked)


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row uids of a part, bytes and offsets of its texts."""
    found = list(blocks(table.column("text"), 1 << 62))
    uid = table.column("uid").to_numpy()
    return (uid, found[0][2], found[0][3]) if found else (uid, np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _fetch(texts: pa.Table, found: pa.Table, width: int) -> pa.Table:
    """The bytes of the pieces a part is asked for, packed per bucket."""
    uid, data, offsets = _texts(texts)
    order = np.argsort(uid)
    out: tuple[list, list] = ([], [])
    for bucket, raw in zip(found.column("bucket").to_pylist(), found.column("asked").to_pylist(), strict=True):
        if raw is None:
            continue
        whose, rank, anchor, start, count = unpack(raw, *ASKED)
        row = order[np.searchsorted(uid, whose, sorter=order)]
        size = count.astype(np.int64) + width - 1
        begin = offsets[row] + start
        at = np.repeat(begin - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
        out[0].append(bucket)
        out[1].append(pack(whose, rank, anchor, start, count, data[at]))
    return pa.table({"bucket": pa.array(out[0], pa.int32()), "load": pa.array(out[1], pa.binary())})


def suffix_array(data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray, width: int, longest: int):
    """Order of the suffixes data[start:end] with equal first ``width`` bytes (``group``) side by side and
    sorted by the rest, and the common prefix of each with the one before it (0 between groups)."""
    rest = longest - width
    columns = start[:, None] + width + np.arange(rest)
    inside = columns < end[:, None]
    tail = np.where(inside, data[np.minimum(columns, len(data) - 1)].astype(np.uint16) + 1, 0)
    order = np.lexsort([*tail.T[::-1], group])
    tail, ends = tail[order], (end - start)[order]
    differ = np.ones((len(order), rest + 1), dtype=bool)
    differ[1:, :rest] = (tail[1:] != tail[:-1]) | (tail[1:] == 0)
    common = np.minimum(width + differ.argmax(axis=1), ends)
    common[np.append(True, group[order][1:] != group[order][:-1])] = 0
    return order, common


def intervals(common: np.ndarray, least: np.ndarray, left: np.ndarray) -> tuple[list[tuple[int, int, int, int, bool]], np.ndarray]:
    """Common-prefix intervals (length, first, last, smallest rank, left-diverse) of a suffix array, by one
    scan with a stack, and for every suffix the length of the deepest left-diverse interval around
    it that holds a rank below its own (0 if none).

    ``left`` is the byte before each suffix, or -1 - i at an edge, which differs from every other.
    """
    found: list[tuple[int, int, int, int, bool]] = []
    lengths = [0] * len(common)
    stack: list[list] = []  # length, first, smallest rank, a left byte, diverse, suffixes without a smaller rank
    ranks, lefts, lcps = least.tolist(), left.tolist(), common.tolist()
    for i in range(len(lcps) + 1):
        lcp = lcps[i] if i < len(lcps) else 0
        first, carried = i - 1, None
        while stack and stack[-1][0] > lcp:
            length, first, low, byte, diverse, waiting = stack.pop()
            found.append((length, first, i - 1, low, diverse))
            if diverse:
                for k in waiting:
                    if ranks[k] > low and not lengths[k]:  # a suffix also waits in the interval it was met in
                        lengths[k] = length
                waiting = [k for k in waiting if not lengths[k]]
            carried = (low, byte, diverse, waiting)
            if stack and stack[-1][0] >= lcp:
                _join(stack[-1], carried)
                carried = None
        if lcp and (not stack or stack[-1][0] < lcp):
            entry = [lcp, first, ranks[first], lefts[first], False, [first]]
            if carried:
                entry[2:] = list(carried)
            stack.append(entry)
            carried = None
        if lcp:
            _join(stack[-1], (ranks[i], lefts[i], False, [i]))
    return found, np.array(lengths, dtype=np.int64)


def _join(entry: list, child: tuple) -> None:
    low, byte, diverse, waiting = child
    entry[4] = entry[4] or diverse or byte != entry[3]
    entry[2] = min(entry[2], low)
    if len(waiting) > len(entry[5]):
        waiting, entry[5] = entry[5], waiting
    entry[5].extend(waiting)


def _windows(data: np.ndarray, begin: np.ndarray, count: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of pieces that lie one behind the other; hashed in blocks of pieces, so that the sums stay small."""
    out = np.empty(int(count.sum(dtype=np.int64)), dtype=np.uint64)
    upto = np.append(0, np.cumsum(count, dtype=np.int64))
    first = 0
    while first < len(begin):
        end = max(first + 1, int(np.searchsorted(begin, begin[first] + BLOCK)))
        n = upto[first + 1 : end + 1] - upto[first:end]
        at = np.arange(upto[end] - upto[first]) + np.repeat(begin[first:end] - begin[first] - upto[first:end] + upto[first], n)
        stop = begin[end] if end < len(begin) else len(data)
        out[upto[first] : upto[end]] = span_hashes(prefix_hashes(data[begin[first] : stop]), at, at + width)
        first = end
    return out


def _repeats(table: pa.Table, parts: int, width: int) -> pa.Table:
    """Maximal repeats of a bucket's pieces as spans per part."""
    (uid, rank, anchor, start, count, data), _ = gathered(table.column("load"), *ASKED, "u1")
    size = count.astype(np.int64) + width - 1
    begin = np.append(0, np.cumsum(size))[:-1]
    window = _windows(data, begin, count, width)
    of = np.repeat(np.arange(len(uid), dtype=np.int32), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count, dtype=np.int64) - count - begin, count)
    left = np.where(at > begin[of], data[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    # Windows found in one document only, or always after the same byte, begin no maximal repeat.
    use = np.argsort(window, kind="stable")
    if len(use):
        fresh = np.append(True, window[use][1:] != window[use][:-1])
        cut, ranks, lefts = np.flatnonzero(fresh), rank[of][use], left[use]
        several = np.minimum.reduceat(ranks, cut) != np.maximum.reduceat(ranks, cut)
        several &= np.minimum.reduceat(lefts, cut) != np.maximum.reduceat(lefts, cut)
        use = use[several[np.cumsum(fresh) - 1]]
    spans = [uid[:0], start[:0], start[:0]]
    if len(use):
        of, at, left = of[use], at[use], left[use]
        longest = int((begin[of] + size[of] - at).max())
        order, common = suffix_array(data, at, begin[of] + size[of], window[use], width, longest)
        of, at = of[order], at[order]
        _, lengths = intervals(common, rank[of], left[order])
        hit = lengths >= width
        begins = (at - begin[of] + start[of])[hit]
        spans = [uid[of[hit]], begins.astype(np.uint32), (begins + lengths[hit]).astype(np.uint32)]
    return _by_part(parts, table.column("bucket")[0].as_py(), spans, [uid[:0], uid[:0]]).select(["part", "spans"])


MEASURES = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_bytes", T.BinaryType()),
]


def _applied(texts: pa.Table, found: pa.Table, names: list[str], kept: str) -> pa.Table:
    """A part's rows with the union of their spans cut out."""
    uid, data, offsets = _texts(texts)
    (whose, start, end), _ = gathered(found.column("spans"), *SPANS)
    order = np.argsort(uid, kind="stable")
    first, last = np.searchsorted(uid, whose, sorter=order), np.searchsorted(uid, whose, side="right", sorter=order)
    change = np.zeros(len(data) + 1, dtype=np.int32)
    for k in range(int((last - first).max()) if len(whose) else 0):  # repeated rows share a uid
        some = first + k < last
        row = order[(first + k)[some]]
        np.add.at(change, offsets[row] + start[some], 1)
        np.add.at(change, offsets[row] + end[some], -1)
    gone = np.cumsum(change, out=change)[:-1] > 0
    rise = gone.copy()
    rise[1:] &= ~gone[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    rise[edges] = gone[edges]
    removed, spans = (np.diff(np.searchsorted(np.flatnonzero(x), offsets)) for x in (gone, rise))
    left = [data[a:b][~gone[a:b]].tobytes() if n else data[a:b].tobytes() for a, b, n in zip(offsets[:-1], offsets[1:], removed, strict=True)]
    if kept == "digest":
        left = [hashlib.sha256(x).hexdigest().encode() for x in left]
    elif kept == "text":
        left = [x.decode("utf-8", "ignore").encode() for x in left]
    columns = [*(texts.column(c) for c in names), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)), pa.array(spans.astype(np.int64)), pa.array(left, pa.binary())]
    return pa.table(columns, names=[*names, *(f.name for f in MEASURES)])


def without_repeats(
    docs: DataFrame,
    width: int = 50,
    text: str = "text",
    doc_id: str = "doc_id",
    keep: list[str] | None = None,
    kept: str = "bytes",
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and, of each text's UTF-8 bytes, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept_bytes``: the bytes left, or with
    ``kept`` as ``text`` only the whole characters of them, as ``digest`` their SHA-256 in hex.

    Removed is every byte covered by a string of ``width`` bytes that also starts in a document with
    a smaller doc_id. A null text is empty; a null doc_id comes after all others; rows that share a
    doc_id do not count against each other. Columns of ``docs`` named like an added one are
    replaced. An empty table gives no rows. A text is held whole in one task.
    """
    added = {f.name for f in MEASURES}
    names = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rank = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(LAST)))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // SHARE))
    rows = docs.select(
        F.struct(F.lit(0).alias(""), *(c for c in names if c != text)).alias("doc"), F.col(text).alias("text"), rank.alias("rank"), F.xxhash64(rank, text).alias("uid")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            uid, ranks = (batch.column(k).to_numpy() for k in (0, 1))
            for first, end, data, offsets in blocks(batch.column(2)):
                owner, start, count, anchor, piece = pieces(data, offsets, width)
                held.add(uid[first:end], ranks[first:end], owner, start - offsets[owner], count, anchor, piece)
                if held.size >= HELD:
                    yield from held.flush(n)
        yield from held.flush(n)

    scanned = rows.select("uid", "rank", "text").mapInArrow(scan, "bucket int, load binary")
    found = materialize(scanned.groupBy("bucket").applyInArrow(lambda t: _settle(t, n, width), FOUND), "found")

    parted = rows.select("doc", "text", "uid", F.pmod("uid", F.lit(n)).cast("int").alias("part"))
    asked = found.where("asked is not null").select("part", "bucket", "asked")
    fetched = (
        parted.groupBy("part")
        .cogroup(asked.groupBy("part"))
        .applyInArrow(lambda a, b: _fetch(a, b, width), "bucket int, load binary")
    )
    compared = fetched.groupBy("bucket").applyInArrow(lambda t: _repeats(t, n, width), "part int, spans binary")
    spans = found.select("part", "spans").unionAll(compared).where("spans is not null")
    whole = [parted.schema["doc"], parted.schema["text"]] if text in names else [parted.schema["doc"]]
    schema = T.StructType([*whole, *MEASURES])
    cut = parted.groupBy("part").cogroup(spans.groupBy("part")).applyInArrow(lambda a, b: _applied(a, b, schema.names[: len(whole)], kept), schema)
    own = [F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in names]
    return cut.select(*own, *(f.name for f in MEASURES))
