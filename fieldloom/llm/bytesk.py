"""Vectorised kernels on the UTF-8 bytes of an Arrow string column.

White space is always the six ASCII characters ``[\\x20\\x09-\\x0D]``. No byte of a multi-byte
UTF-8 sequence is below 0x80, so splitting, stripping and lower-casing A-Z on bytes equals doing it
on characters. A whole batch is handled by a handful of numpy calls; nothing loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Seeds of the two independent hashes; odd, so that multiplying by them is a bijection.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is the empty text."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        values = values.fill_null("")
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each, one row at least, so scratch arrays stay small."""
    n, at = len(off) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, off: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row the number of words before it (one more entry than rows). between: the bytes that are in no word."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    space = between[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[off] = True
    starts = np.flatnonzero(~space & edge[:-1])
    edge[1:-1] = space[1:]
    edge[off] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASES[0]) -> np.ndarray:
    """64-bit hashes of disjoint ascending byte spans, none of them empty.

    Blocks of eight bytes are mixed with their place in the span before they are summed: no sum of products, in which regular
    texts cancel out (polynomials modulo 2 ** 64 give Thue-Morse words and their complements equal hashes, whatever the base).
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each byte on
    blocks = (size + 7) >> 3
    if blocks.max() == 1:
        values = eight[starts] & (~np.uint64(0) >> (np.uint64(64) - (size << 3).astype(np.uint64)))
        return mix(mix((values ^ base) + STEP) + size.astype(np.uint64) * base)
    first = np.cumsum(blocks) - blocks
    out = np.empty(len(starts), np.uint64)
    for at, to in slices(np.append(first, first[-1] + blocks[-1]), 1 << 18):
        n = blocks[at:to]
        begin = first[at:to] - first[at]
        inside = np.arange(int(n.sum())) - np.repeat(begin, n)
        left = np.minimum(np.repeat(size[at:to], n) - (inside << 3), 8)
        values = eight[(inside << 3) + np.repeat(starts[at:to], n)] & (~np.uint64(0) >> (np.uint64(64) - (left << 3).astype(np.uint64)))
        out[at:to] = np.add.reduceat(mix((values ^ base) + (inside + 1).astype(np.uint64) * STEP), begin)
    return mix(out + size.astype(np.uint64) * base)


def doubled(hashes: np.ndarray, m: int, by: int, base: np.uint64) -> np.ndarray:
    """Hashes of runs of m + by entries from those of runs of m; by is from 1 to m, so runs may overlap."""
    return mix(hashes[: len(hashes) - by] * base + mix(hashes[by:] + np.uint64(int(STEP) * (m + by) % (1 << 64))))


def rolling(hashes: np.ndarray, k: int, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Hashes of all runs of k consecutive entries, by doubling their length; runs may cross rows, callers mask those."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out, m = mix(hashes ^ base), 1
    while m < k:
        by = min(m, k - m)
        out, m = doubled(out, m, by, base), m + by
    return out


def range_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASES[0]) -> np.ndarray:
    """Hashes of arbitrary runs [start, end) of entries, none of them empty, from the two longest runs of a power of two in each."""
    n = ends - starts
    out, level, m = np.zeros(len(starts), np.uint64), mix(hashes ^ base), 1
    while len(n) and m <= n.max():
        mine = np.flatnonzero((n >= m) & (n < 2 * m))
        out[mine] = mix(level[starts[mine]] * base + mix(level[ends[mine] - m] + STEP * n[mine].astype(np.uint64)))
        m *= 2
        if m <= n.max():
            level = doubled(level, m // 2, m // 2, base)
    return out


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of characters before each byte (one more entry than bytes)."""
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=total[1:])
    return total
