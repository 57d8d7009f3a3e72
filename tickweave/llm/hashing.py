"""Words, hashes and shingles of whole batches of texts, in numpy.

A batch is one byte buffer with document borders. Words are runs of bytes other than
space and 0x09-0x0D, with A to Z lower-cased. The hash of a word is the difference of
two prefix sums of a random-table polynomial modulo 2**64, passed through a mixer, so
no string is made for any word. That polynomial can't tell some strings of two letters
apart once they are long (Thue-Morse words), so runs above ``SHORT`` bytes are named by
xxh3 of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Longer runs of bytes are named by xxh3.
SHORT = 32
#: Powers that a worker keeps for later batches.
KEPT = 1 << 21
_ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_ROOT, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_powers = [np.ones(1, U64), np.ones(1, U64)]

#: A to Z to lower case, 0x09-0x0D to space
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power(n: int, k: int, base: int) -> np.ndarray:
    if len(_powers[k]) >= n:
        return _powers[k][:n]
    steps = np.full(max(n, 1 << 16), base, U64)
    steps[0] = 1
    made = np.multiply.accumulate(steps)
    # workers are reused, so what one very long text needs isn't kept
    if n <= KEPT:
        _powers[k] = made
    return made[:n]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the borders of the documents; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_TABLE[data] * _power(len(data), 0, _ROOT), out=out[1:])
    return out


def span_hash(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs ``start:end``; equal bytes give equal hashes wherever they stand."""
    back = _power(len(sums), 1, _INVERSE)
    out = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(U64))
    far = np.flatnonzero(end - start > SHORT)
    if len(far):
        view, name = memoryview(data), xxhash.xxh3_64_intdigest
        both = zip(start[far].tolist(), end[far].tolist(), strict=True)
        out[far] = np.fromiter((name(view[a:b]) for a, b in both), U64, len(far))
    return out


def raw_hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes whose high half is well spread; cheaper than :func:`span_hash`."""
    out = sums[size:] - sums[:-size]
    out *= _power(len(sums), 1, _INVERSE)[: len(out)]
    out ^= out >> U64(32)
    out *= U64(0xFF51AFD7ED558CCD)
    return out


def words(
    data: np.ndarray, borders: np.ndarray, sums: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document and start of every word, in order; ``data`` is folded already, ``sums`` are its prefix sums."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = data != 32
    # a border between two documents ends a word even where no space stands
    flips = inside[1:] != inside[:-1]
    starts = np.flatnonzero(flips & inside[1:])
    ends = np.flatnonzero(flips & inside[:-1])
    cut = borders[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut + 1]]
    if len(cut):
        starts, ends = np.sort(np.r_[starts, cut]), np.sort(np.r_[ends, cut])
    doc = np.searchsorted(borders, starts, "right") - 1
    return span_hash(data, prefix_sums(data) if sums is None else sums, starts, ends), doc, starts


def shingles(word: np.ndarray, doc: np.ndarray, n_docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every run of ``size`` words; a shorter document is one shingle of all its words."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.r_[0, np.cumsum(count)]
    keep = np.zeros(len(word), bool)
    if len(word) >= size:
        keep[: len(word) - size + 1] = doc[: len(word) - size + 1] == doc[size - 1 :]
    at = np.flatnonzero(keep)
    h = np.zeros(len(at), U64)
    for i in range(size):
        h = mix(h + word[at + i])
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        g = np.zeros(len(short), U64)
        for i in range(size - 1):
            has = count[short] > i
            g[has] = mix(g[has] + word[first[short[has]] + i])
        h, d = np.r_[h, mix(g + count[short].astype(U64))], np.r_[doc[at], short]
        order = np.argsort(d, kind="stable")
        return h[order], d[order]
    return h, doc[at]
