"""Vectorised text kernels shared by the corpus operators that run in Python workers.

A worker receives Arrow batches. ``slices`` cuts them to blocks of about ``BLOCK`` bytes of text, so
that temporary arrays stay small whatever the batch or the texts are (one longer text is a block by
itself). Within a block, words, lines and n-grams are found and hashed with NumPy over the UTF-8
bytes of all texts at once.

A token's hash is the sum of its bytes, each times a pseudo-random 64-bit number of its place within
the token, and is then mixed; equal tokens have equal hashes wherever they stand, in whichever
worker. Unlike a polynomial modulo 2**64, whose coefficients are powers of one number, it has no
strings that are sure to collide: two given tokens do with a chance of 2**-57 or less over the choice
of the numbers. The bytes of one very long text are hashed by segments; finding its words takes about
four bytes of memory a byte of text, and each word or line about 40 more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U = np.uint64
def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


#: A factor for each place in a token; a longer token is cut to pieces of this many bytes.
_LONGEST = 1 << 16
_FACTORS = mix(np.arange(1, _LONGEST + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after folding A-Z), as sets of UTF-8 bytes.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
NOT_NEWLINE = ~byte_set((0x0A, 0x0A))


def slices(batch: pa.RecordBatch, text: int, most: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(sub-batch, its text bytes, offsets of its texts); a null text counts as empty."""
    column = batch.column(text)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _short(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over spans of 1 to _LONGEST bytes, in order and apart from each other."""
    low = starts[0]
    at = np.arange(ends[-1] - low) - np.repeat(starts - low, np.diff(starts, append=ends[-1]))
    values = (data[low : ends[-1]].astype(U) + U(1)) * _FACTORS[np.minimum(at, _LONGEST - 1)]
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts - low, ends - low
    return np.add.reduceat(values, edges[:-1])[::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each span, which are in order and apart from each other; empty spans hash alike. fold: A-Z as a-z."""
    out = np.zeros(len(starts), U)
    size = ends - starts
    filled = np.flatnonzero(size)
    if len(filled):
        a, b = starts[filled], ends[filled]
        if (long := size[filled] > _LONGEST).any():
            # pieces of long spans, which are hashed again as numbers
            count = -(-(b - a) // _LONGEST)
            own = np.repeat(np.arange(len(a)), count)
            nth = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            a, b = a[own] + nth * _LONGEST, np.minimum(a[own] + (nth + 1) * _LONGEST, b[own])
        sums = np.empty(len(a), U)
        k = 0
        while k < len(a):
            m = max(k + 1, int(np.searchsorted(b, a[k] + BLOCK, "right")))
            part = data[a[k] : b[m - 1]]
            sums[k:m] = _short(_LOWER[part] if fold else part, a[k:m] - a[k], b[k:m] - a[k])
            k = m
        if long.any():
            heads = np.cumsum(count) - count
            # a token of one piece hashes as it does beside no long one
            sums = np.where(count == 1, sums[heads], np.add.reduceat(mix(sums + nth.astype(U) * U(0xD6E8FEB86659FD93)), heads))
        out[filled] = sums
    return mix(out + size.astype(U) * U(0xA0761D6478BD642F))


def count_in(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of marked bytes of each text."""
    out = np.zeros(len(offsets) - 1, np.int64)
    some = offsets[1:] > offsets[:-1]
    if some.any():
        out[some] = np.add.reduceat(mask, offsets[:-1][some], dtype=np.int64)
    return out


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``member``, cut at text ends: starts, ends, and each text's first run."""
    inside = member[data]
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """\\n-split lines, empty ones included, as starts, ends and each text's first line; a text has one at least."""
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(breaks, offsets)
    counts = np.diff(own) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    starts[is_first], starts[~is_first] = offsets[:-1], breaks + 1
    ends[is_last], ends[~is_last] = offsets[1:], breaks
    return starts, ends, first


def owners(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ngrams(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n tokens from each place on, also across text ends; the last n-1 places have none."""
    m = len(tokens) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.zeros(m, U)
    for j in range(n):
        out *= U(0x5851F42D4C957F2D)
        out += tokens[j : j + m]
    return mix(out + U(n))


def whole(first: np.ndarray, n: int, owner: np.ndarray | None = None) -> np.ndarray:
    """For each n-gram place, whether it stays within one text."""
    owner = owners(first) if owner is None else owner
    m = len(owner) - n + 1
    return owner[:m] == owner[n - 1 :] if m > 0 else np.zeros(0, bool)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values over each text's range."""
    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte, one entry more than bytes."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
