"""Hashed word shingles of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# A random number per byte value, so that sums over bytes spread over all bits.
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


# Bytes that are hashed at a time; powers are kept for so many places.
BLOCK = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_BACK, BLOCK)


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of the texts in them); a null text is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] if len(offsets) else 0 : offsets[-1] if len(offsets) else 0]
    return raw, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, number of the text it is in)."""
    raw, offsets = utf8_parts(texts)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start, end = ~space, ~space
    start[1:] &= space[:-1] | edge[1:-1]
    end[:-1] &= space[1:] | edge[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = np.empty(len(a), np.uint64)
    at = 0
    while at < len(a):
        # As many whole words as fit into a block; one that is longer has a block of its own.
        upto = max(at + 1, int(np.searchsorted(b, a[at] + BLOCK, "right")))
        first, last = a[at], b[upto - 1]
        n = int(last - first)
        up, down = (_UP, _DOWN) if n <= BLOCK else (_powers(_BASE, n), _powers(_BACK, n))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[_LOWER[raw[first:last]]] * up[:n], out=total[1:])
        begin, end_ = a[at:upto] - first, b[at:upto] - first
        words[at:upto] = mixed((total[end_] - total[begin]) * down[begin] + (end_ - begin).astype(np.uint64))
        at = upto
    return words, np.searchsorted(offsets, a, "right") - 1


def _joined(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : len(words) - size + 1 + j]
    return mixed(out + np.uint64(size))


# Texts that are hashed at a time, so that a large Arrow batch holds little beside its sets.
TEXTS = 1000


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; fewer than ``size`` words make one shingle, no words none."""
    return [s for at in range(0, len(texts), TEXTS) for s in _sets(texts.slice(at, TEXTS), size)]


def _sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    words, owner = word_hashes(texts)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    all_ = _joined(words, size) if len(words) >= size else np.empty(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(all_[a : b - size + 1]))
        elif b > a:
            out.append(_joined(words[a:b], b - a))
        else:
            out.append(np.empty(0, np.uint64))
    return out
