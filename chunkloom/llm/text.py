"""Words and hashes of whole texts, computed on the bytes of an Arrow column with numpy.

A batch is walked in blocks of whole texts of about ``BLOCK`` bytes, so that the working arrays
stay small; a longer text is a block of its own. Nulls count as empty texts. Words are runs of
bytes other than space and 0x09 to 0x0D; these bytes never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, list[np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse modulo 2^64; those for a block are kept."""
    size = max(n, BLOCK + BLOCK // 4)
    if size not in _powers:
        made = []
        for base in (BASE, INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > BLOCK + BLOCK // 4:
            return made[0][:n], made[1][:n]
        _powers[size] = made
    up, down = _powers[size]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of whole texts; offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the spans [start, end)."""
    _, down = powers(len(sums))
    raw = (sums[end] - sums[start]) * down[start]
    return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the first word of each text (one more at the end).

    ``between`` flags the bytes that are no part of a word."""
    inside = ~between[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of each text and their text numbers.

    A text with fewer words, but at least one, has its whole sequence as its only run.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs) + bounds[:-1][owner]
    out = np.full(len(owner), 0x2545F4914F6CDD1D, dtype=np.uint64)
    left = np.minimum(counts, size)[owner]
    for k in range(size):
        use = left > k
        step = mix(out * np.uint64(0x9FB21C651E98DF25) + words[np.minimum(at + k, max(len(words) - 1, 0))]) if len(words) else out
        out = np.where(use, step, out)
    return mix(out + left.astype(np.uint64)), owner


def sets(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text in ascending order, and the bounds of each text's part."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return hashes, np.searchsorted(owner, np.arange(texts + 1))


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary Arrow column holding the values of each part."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(),
        len(bounds) - 1,
        [None, pa.py_buffer((bounds.astype(np.int64) * width).tobytes()), pa.py_buffer(raw.tobytes())],
    ).cast(pa.binary())
