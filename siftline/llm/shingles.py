"""Word shingles of a column of codes, computed on whole Arrow buffers with numpy.

A *word* is a longest run of ASCII letters, digits and underscores (case kept); a *shingle* is a run of
``width`` consecutive words.  Each shingle becomes a 48-bit number: 16 bits stay free for the row's place
in the batch, so that one integer sort yields the sorted distinct shingles of every row at once.

Two different shingles share a number with probability 2**-48; within one pair of rows of 1,000 shingles
that moves a likeness by one shingle once in 10**8 pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BITS = 48
MASK = np.uint64((1 << BITS) - 1)
#: Rows with fewer words than this have no likeness to anything.
LEAST_WORDS = 20
_CHUNK = 1 << 20

_WORD = np.zeros(256, bool)
for _c in b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    if (p := _POWERS.get(base)) is None or len(p) <= n:
        p = np.full(max(n, _CHUNK) + 1, base, np.uint64)
        p[0] = 1
        _POWERS[base] = p = np.multiply.accumulate(p)
    return p


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64)
    data = texts.buffers()[2]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each the number of its row."""
    data, at = _buffers(texts)
    hashes, rows = [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + _CHUNK)
        while hi < n and _WORD[data[hi]] and _WORD[data[hi - 1]]:  # never cut a word
            hi += 1
        part = data[lo:hi]
        inside = _WORD[part]
        edges = at[(at > lo) & (at < hi)] - lo
        before, after = np.zeros(len(part), bool), np.zeros(len(part), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edges], after[edges - 1] = False, False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[part] * _powers(_BASE, len(part))[: len(part)], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * _powers(_INVERSE, len(part))[start] + (end - start).astype(np.uint64)))
        rows.append(np.searchsorted(at, start + lo, "right") - 1)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(rows)


def shingles(texts: pa.Array, width: int = 3, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of every row, end to end, and where each row's begin (one more entry than
    rows).  Null rows and rows of fewer than ``least`` words have none."""
    n = len(texts)
    if n > 1 << (64 - BITS):
        half = n // 2
        a, b = shingles(texts[:half], width, least), shingles(texts[half:], width, least)
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1][1:] + a[1][-1]])
    hashes, rows = words(texts)
    enough = np.bincount(rows, minlength=n) >= max(least, width)
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    last = len(hashes) - width + 1
    whole = (rows[:last] == rows[width - 1 :]) & enough[rows[:last]]
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + last])
    keys = (rows[:last][whole].astype(np.uint64) << np.uint64(BITS)) | (h[whole] >> np.uint64(64 - BITS))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    begin = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(BITS)) if n < 1 << (64 - BITS) else np.append(np.searchsorted(keys, np.arange(n, dtype=np.uint64) << np.uint64(BITS)), len(keys))
    return keys & MASK, begin


def set_ids(sets: np.ndarray, begin: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A 64-bit id of each row's set, another for another salt."""
    n = np.diff(begin)
    ids = np.zeros(len(n), np.uint64)
    if full := np.flatnonzero(n).tolist():
        ids[full] = np.add.reduceat(mix(sets + np.uint64(salt)), begin[:-1][full])
    return mix(ids + n.astype(np.uint64))
