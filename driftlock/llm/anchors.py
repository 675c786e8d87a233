"""Windows of bytes and the anchors that their contents choose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from driftlock.llm.shingles import _BACK, _BASE, _VALUE, _powers, mixed

# Bytes of the grams among which a window chooses its anchor.
GRAM = 64
# Windows handled at a time; a longer text is cut into runs of windows, which changes no anchor.
BLOCK = 1 << 19
_ROOM = 3 * BLOCK
_UP, _DOWN = _powers(_BASE, _ROOM), _powers(_BACK, _ROOM)
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _UP[: len(raw)], out=total[1:])
    return mixed((total[GRAM:] - total[:-GRAM]) * _DOWN[: len(raw) - GRAM + 1])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each run of ``width`` neighbours, by running minima from both ends of blocks."""
    n = len(keys)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    table = padded.reshape(-1, width)
    forward = np.minimum.accumulate(table, axis=1).ravel()
    backward = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchor_runs(raw: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, anchor hash, content hash, first window, its distance to the anchor, number of windows) of
    all runs of windows with one anchor; the content is all bytes that the windows of the run cover.

    A window of ``window`` bytes chooses the gram with the least hash, of equal ones the first. Equal windows so have
    equal anchors at equal places, wherever they are. Windows are numbered by their first byte in their text.
    """
    pieces: list[tuple[int, int, int, int]] = []
    size = 0
    lengths = np.diff(offsets)
    for text in np.flatnonzero(lengths >= window):
        windows = int(lengths[text]) - window + 1
        for start in range(0, windows, BLOCK):
            count = min(BLOCK, windows - start)
            if pieces and size + count + window > BLOCK:
                yield _runs(raw, pieces, window)
                pieces, size = [], 0
            pieces.append((int(text), int(offsets[text]) + start, count, start))
            size += count + window
    if pieces:
        yield _runs(raw, pieces, window)


def _runs(raw: np.ndarray, pieces: list[tuple[int, int, int, int]], window: int) -> tuple[np.ndarray, ...]:
    part = np.concatenate([raw[at : at + count + window - 1] for _, at, count, _ in pieces])
    grams = _gram_hashes(part)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_least(keys, window - GRAM + 1) & _PLACE).astype(np.int64)
    counts = np.array([c for _, _, c, _ in pieces])
    begins = np.concatenate([[0], np.cumsum(counts + window - 1)[:-1]])
    # Windows that lie within one piece, with the piece of each.
    piece = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    chosen = chosen[begins[piece] + within]
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(piece)] - 1
    text = np.array([t for t, _, _, _ in pieces])[piece[first]]
    start = np.array([s for _, _, _, s in pieces])[piece[first]]
    at = begins[piece[first]] + within[first]
    count = last - first + 1
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(_VALUE[part] * _UP[: len(part)], out=total[1:])
    content = mixed((total[at + count + window - 1] - total[at]) * _DOWN[at] + count.astype(np.uint64))
    return text, grams[chosen[first]], content, start + within[first], chosen[first] - at, count
