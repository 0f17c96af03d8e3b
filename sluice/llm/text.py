"""Texts in Arrow batches as flat byte arrays, and word and shingle hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
DOC_BITS = 10
HASH_BITS = 64 - DOC_BITS
HASH_MASK = np.uint64((1 << HASH_BITS) - 1)

# The blank characters of the word contracts (space, tab to carriage return).
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt) * np.uint64(1 << 32)) | np.uint64(1)


BYTE_CODES = seeds(256, 1)
BYTE_CODES[BLANK] = 0
STEP = int(seeds(1, 2)[0])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and the row offsets; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES, rows: int = (1 << DOC_BITS) - 1) -> Iterator[tuple[int, int]]:
    """Runs of whole rows with about ``limit`` bytes and at most ``rows`` rows."""
    at, last = 0, len(offsets) - 1
    while at < last:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), at + rows, last)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and its row. A word is a run of bytes that are no blanks."""
    full = ~BLANK[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = full[edge]
    last[edge - 1] = full[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial in its bytes, scrambled."""
    if not len(start):
        return np.zeros(0, np.uint64)
    longest = int((end - start).max())
    powers = np.full(longest, STEP, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    place = np.arange(len(data))
    place -= np.repeat(np.concatenate([[0], start[1:]]), np.diff(np.concatenate([[0], start[1:], [len(data)]])))
    place[:start[0]] = 0
    if start[0]:
        place[start[0]:start[1] if len(start) > 1 else None] -= start[0]
    np.minimum(place, longest - 1, out=place)
    return mixed(np.add.reduceat(BYTE_CODES[data] * powers[place], start))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, end row, the rows' distinct shingle hashes (ascending in
    each row) and their offsets. A-Z is lower-cased; a text of fewer than ``k`` words is one
    shingle; a text without words has none."""
    data, offsets = flat(texts)
    coefs = seeds(k, 3)
    for at, to in pieces(offsets):
        base = offsets[at]
        part, cut = LOWER[data[base:offsets[to]]], offsets[at:to + 1] - base
        start, end, row = words(part, cut)
        h = word_hashes(part, start, end)
        counts = np.bincount(row, minlength=to - at)
        ends = np.cumsum(counts)
        inside = np.arange(len(h)) - (ends - counts)[row]
        head = np.flatnonzero(inside <= np.maximum(counts[row] - k, 0))
        total = np.zeros(len(head), np.uint64)
        for j in range(k):
            there = head + j
            ok = there < ends[row[head]]
            total += np.where(ok, h[np.minimum(there, len(h) - 1)] * coefs[j], np.uint64(0)) if len(h) else np.uint64(0)
        keyed = (row[head].astype(np.uint64) << np.uint64(HASH_BITS)) | (mixed(total) >> np.uint64(DOC_BITS))
        keyed.sort()
        if len(keyed):
            keyed = keyed[np.concatenate([[True], keyed[1:] != keyed[:-1]])]
        sizes = np.bincount((keyed >> np.uint64(HASH_BITS)).astype(np.int64), minlength=to - at)
        yield at, to, keyed & HASH_MASK, np.concatenate([[0], np.cumsum(sizes)])
