"""Vectorised words, hashes and shingles over the byte buffers of Arrow text columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's 64-bit
hash is a polynomial over randomised byte values, taken with prefix sums over the
whole buffer, so no Python string is made. Texts are worked off in blocks of about
``block_bytes`` bytes that end between words, so memory does not follow a text's
length (a single word longer than a block is taken whole).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2^64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + U64(1)) * _STEP)


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(data: np.ndarray, breaks: np.ndarray | None = None, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of ``data``; words also end at ``breaks``."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    if breaks is not None:
        b = breaks[(breaks > 0) & (breaks < len(data))]
        starts[b] = inside[b]
        ends[b - 1] = inside[b - 1]
    at, to = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mix((sums[to] - sums[at]) * down[at] + (to - at).astype(np.uint64)), at, to


def blocks(offsets: np.ndarray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``block_bytes`` bytes together, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + block_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def pieces(data: np.ndarray, block_bytes: int = BLOCK_BYTES, least_bytes: int = 1) -> Iterator[tuple[int, int]]:
    """Ranges of one long text that end after a word of at least ``least_bytes`` bytes."""
    at = 0
    while at < len(data):
        end, seen = min(at + block_bytes, len(data)), at
        while end < len(data):
            here = max(at, seen - least_bytes)
            space = SPACE[data[here:end]]
            stop = space.copy()
            for k in range(1, least_bytes + 1):
                stop[k:] &= ~space[:-k]
                stop[:k] = False
            found = np.flatnonzero(stop)
            if len(found):
                end = here + int(found[-1]) + 1
                break
            seen, end = end, min(end + block_bytes, len(data))
        yield at, end
        at = end


def words_before(data: np.ndarray, at: int, words: int) -> int:
    """Where the last ``words`` words before a place begin."""
    seen = 256
    while True:
        start = max(0, at - seen)
        inside = ~SPACE[data[start:at]]
        begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if len(begins) > words or not start:
            return start + int(begins[-words]) if len(begins) >= words else start
        seen *= 4


def words_by_row(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, word hashes, row of each word from the first row on)``, block by block."""
    data, offsets = text_buffer(column)
    for row, end in blocks(offsets, block_bytes):
        own = data[offsets[row] : offsets[end]]
        if end == row + 1:
            parts = [word_hashes(own[a:b])[0] for a, b in pieces(own, block_bytes)]
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield row, end, hashes, np.zeros(len(hashes), np.int64)
        else:
            inner = offsets[row : end + 1] - offsets[row]
            hashes, at, _ = word_hashes(own, inner[1:-1])
            yield row, end, hashes, np.searchsorted(inner, at, side="right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every window of ``size`` words inside one row.

    A row with fewer words, but at least one, has a single shingle of them all.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.bincount(rows)
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total = mix(total + hashes[k : n - size + 1 + k] + _STEP)
        whole = rows[: n - size + 1] == rows[size - 1 :]
        out, own = total[whole], rows[: n - size + 1][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.searchsorted(rows, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            here = counts[short] > k
            total[here] = mix(total[here] + hashes[first[here] + k] + _STEP)
        out, own = np.concatenate([out, mix(total + counts[short].astype(np.uint64))]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def multisets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash) sorted by row, then hash, with their counts."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    return h[at], r[at], np.diff(np.append(at, len(h)))
