"""Vectorised word and shingle hashing over UTF-8 buffers (numpy, no Spark).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  A word's hash
is a polynomial over randomly mapped bytes modulo 2**64, finalised by a
bijective mixer, so equal words hash alike and a collision between two
different words has a probability of about 2**-60.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63 - 1, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C55
_INV = pow(_BASE, -1, 2**64)
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; a longer run without a separator extends a block.
BLOCK = 1 << 20
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow["up"]) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _pow[name] = np.multiply.accumulate(p)
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _hash_block(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts that lie one after another.

    ``data`` holds UTF-8 bytes, text i is ``data[offsets[i]:offsets[i+1]]``.
    Returns all hashes and, with one more entry than texts, where each text's
    words begin.  Memory beyond the result is bounded by BLOCK, not by a text,
    unless one word alone is longer.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    word = ~_SEP[data[lo:hi]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = np.asarray(offsets[1:-1] - lo)
    cuts = cuts[(cuts > 0) & (cuts < hi - lo)]
    first[cuts] = word[cuts]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    del first, last, word
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a = int(starts[i])
        block = data[lo + a : lo + int(ends[j - 1])]
        out[i:j] = _hash_block(LOWER[block] if lower else block, starts[i:j] - a, ends[i:j] - a)
        i = j
    return out, np.searchsorted(starts, np.asarray(offsets) - lo).astype(np.int64)


_COEF = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_sets(words: np.ndarray, begin: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct, sorted hashes of each text's ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle, a text
    without words has none.  Returns the sets one after another and their
    begins.
    """
    n = len(words)
    h = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        h += words[k : n - width + 1 + k] * _COEF[k % 5] ^ np.uint64(k * 0x1000193)
    h = mix(h)
    parts, sizes = [], [0]
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a >= width:
            s = np.unique(h[a : b - width + 1])
        elif b > a:
            s = np.array([b - a], np.uint64)
            for k in range(a, b):
                s = mix(s * np.uint64(31) + words[k : k + 1])
        else:
            s = h[:0]
        parts.append(s)
        sizes.append(len(s))
    return (np.concatenate(parts) if parts else h[:0]), np.cumsum(sizes)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a pyarrow string array; nulls become empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = 4 << 20):
    """Ranges of texts of about ``most`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
