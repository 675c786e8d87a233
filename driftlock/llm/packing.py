"""Packing documents into training sequences: vector bin packing with the dot-product heuristic.

A document is tokenised where it is read; its full-length pieces are sequences of their own. What is left of it is an
item with a demand vector (tokens, segments, loss-bearing tokens). Bins are opened one at a time and always take the
item whose demand, weighted by what the bin has left, has the largest dot product. When no item fits, the longest one
is cut so that the bin is full, or has all the loss-bearing tokens it may have. Items of each partition are packed in windows of bounded size and the rest goes on to
the next window, so only the last sequence of a partition is padded. There is no shuffle.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE_TOKENS = 1024
MAX_SEGMENTS = 64
# Of a piece, every token but its first has a prediction, hence a loss if it bears one. Where all tokens do, a sequence
# has at most so many, and the limit does not bind.
MAX_LOSS_TOKENS = 1023
# Documents whose remainders are packed together.
WINDOW = 4096
TOKENIZER = "byte_bpe_50k"
END = 0


class Items:
    """Remainders that wait for a place: the tokens of each and how many are already placed."""

    def __init__(self) -> None:
        self.doc: list[int] = []
        self.ids: list[np.ndarray] = []
        # For each token, how many up to it bear a loss; None where all do.
        self.bearing: list[np.ndarray | None] = []
        self.at: list[int] = []
        self.total: list[int] = []

    def __len__(self) -> int:
        return len(self.doc)

    def add(self, doc, ids: np.ndarray, bearing: np.ndarray | None, at: int, total: int) -> None:
        self.doc.append(doc)
        self.ids.append(ids)
        self.bearing.append(bearing)
        self.at.append(at)
        self.total.append(total)


def loss_tokens(bearing: np.ndarray | None, start: int, end: int) -> int:
    """The loss-bearing tokens of a piece: those after its first token."""
    return end - start - 1 if bearing is None else int(bearing[end - 1] - bearing[start])


def longest_piece(bearing: np.ndarray | None, start: int, left: int, room_tokens: int, room_losses: int) -> int:
    """The tokens from ``start`` on that both limits leave room for."""
    if bearing is None:
        return min(left, room_tokens, room_losses + 1)
    return min(left, room_tokens, int(np.searchsorted(bearing, bearing[start] + room_losses, "right")) - start)


def pack_window(
    lengths: np.ndarray, limits: tuple[int, int, int], to_end: bool, bearing: list[np.ndarray | None] | None = None
) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """(bins of (item, from, to), how far each item is placed).

    Without ``to_end``, packing stops when the items left can't fill a bin. A piece is one segment, and its loss-bearing
    tokens are those after its first token that ``bearing`` counts, a running count for each item; by default all.
    """
    tokens, segments, losses = limits
    left = lengths.astype(np.int64).copy()
    bearing = bearing or [None] * len(lengths)
    owed = np.array([loss_tokens(b, 0, int(n)) for b, n in zip(bearing, lengths)], np.int64)
    bins: list[list[tuple[int, int, int]]] = []
    weight = 1.0 / np.array([tokens, segments, max(1, losses)], float)
    demand = np.stack([left, np.ones_like(left), owed]).astype(float)
    remaining = int(left.sum())
    while remaining >= (1 if to_end else tokens):
        room = np.array([tokens, segments, losses], np.int64)
        bin_: list[tuple[int, int, int]] = []
        while room[0] > 0 and room[1] > 0:
            fits = (left > 0) & (left <= room[0]) & (owed <= room[2])
            if fits.any():
                score = (room * weight * weight) @ demand
                score[~fits] = -1.0
                item = int(score.argmax())
                size = int(left[item])
            else:
                item = int(left.argmax())
                if left[item] <= 0 or bin_ and room[2] <= 0:
                    break
                size = longest_piece(bearing[item], int(lengths[item] - left[item]), int(left[item]), int(room[0]), int(room[2]))
                if size <= 0:
                    break
            start = int(lengths[item] - left[item])
            bin_.append((item, start, start + size))
            room -= np.array([size, 1, loss_tokens(bearing[item], start, start + size)])
            left[item] -= size
            owed[item] = loss_tokens(bearing[item], start + size, int(lengths[item])) if left[item] else 0
            demand[0, item], demand[2, item] = left[item], owed[item] if left[item] else -1
            remaining -= size
        bins.append(bin_)
    return bins, lengths - left


@lru_cache(maxsize=2)
def _encoders(name: str):
    """The same vocabulary twice: ranks, which are fast, and the full tokenizer for texts with a special token."""
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    return fast, full, special


def token_ids(text: str, name: str = TOKENIZER) -> np.ndarray:
    """The ids of a text and the end id."""
    fast, full, special = _encoders(name)
    if any(s in text for s in special):
        ids = full.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_ordinary(text)
    ids.append(END)
    return np.array(ids, "<u4")


def bearing_tokens(text: str, ids: np.ndarray, ranges: list[dict | None] | None, name: str = TOKENIZER) -> np.ndarray | None:
    """For each token, how many up to it bear a loss: tokens with a byte in one of the ranges, and the end id if a range
    reaches the end of the text. Ranges are (start, end) in code points, end exclusive; no list means all tokens.
    """
    if ranges is None:
        return None
    fast, full, _ = _encoders(name)
    special = {i: t.content for i, t in full.get_added_tokens_decoder().items()}
    sizes = [len(special[i].encode() if i in special else fast.decode_single_token_bytes(i)) for i in ids[:-1].tolist()]
    ends = np.cumsum(sizes, dtype=np.int64)
    raw = np.frombuffer(text.encode(), np.uint8)
    if len(raw) != (ends[-1] if len(ends) else 0):
        raise ValueError("the tokens of a text do not have its bytes")
    # Bytes before each code point, and before the end.
    before = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
    marked = np.zeros(len(ids), bool)
    for r in ranges:
        if r is None:
            continue
        a, b = (len(before) - 1 if x is None else min(max(x, 0), len(before) - 1) for x in (r["start"] or 0, r["end"]))
        if a < b:
            first = np.searchsorted(ends, before[a], "right")
            marked[first : np.searchsorted(ends, before[b], "left") + 1] = True
        marked[-1] |= a <= b == len(before) - 1
    return np.cumsum(marked)


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_PIECE_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])


LOSS_PIECE = f"{PIECE}, loss_tokens bigint"
_LOSS_PIECE_ARROW = _PIECE_ARROW.append(pa.field("loss_tokens", pa.int64()))


def _packer(limits: tuple[int, int, int], window: int, tokenizer: str, with_losses: bool = False):
    size = limits[0]
    schema = _LOSS_PIECE_ARROW if with_losses else _PIECE_ARROW

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task that runs again reads the same rows in the same order and numbers its sequences alike.
        number = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        waiting = Items()

        def placed(doc, ids: np.ndarray, bearing: np.ndarray | None, at: int, total: int, offset: int) -> None:
            losses = (loss_tokens(bearing, 0, len(ids)),) if with_losses else ()
            rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), total, number, offset, *losses))

        def part(bearing: np.ndarray | None, a: int, b: int | None = None) -> np.ndarray | None:
            return None if bearing is None else bearing[a:b]

        def settle(to_end: bool) -> None:
            nonlocal number, waiting
            lengths = np.array([len(x) for x in waiting.ids], np.int64)
            bins, done = pack_window(lengths, limits, to_end, waiting.bearing)
            for bin_ in bins:
                offset = 0
                for item, a, b in bin_:
                    placed(waiting.doc[item], waiting.ids[item][a:b], part(waiting.bearing[item], a, b), waiting.at[item] + a, waiting.total[item], offset)
                    offset += b - a
                number += 1
            rest = Items()
            for item in np.flatnonzero(done < lengths):
                d = int(done[item])
                rest.add(waiting.doc[item], waiting.ids[item][d:], part(waiting.bearing[item], d), waiting.at[item] + d, waiting.total[item])
            waiting = rest

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(schema)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            ranges = batch.column("ranges").to_pylist() if with_losses else [None] * batch.num_rows
            for doc, text, bears in zip(batch.column("doc_id").to_pylist(), batch.column("text"), ranges):
                ids = token_ids(text.as_py() or "", tokenizer)
                bearing = bearing_tokens(text.as_py() or "", ids, bears, tokenizer)
                whole = len(ids) // size * size if limits[2] >= size - 1 else 0
                for at in range(0, whole, size):
                    placed(doc, ids[at : at + size], part(bearing, at, at + size), at, len(ids), 0)
                    number += 1
                if whole < len(ids):
                    waiting.add(doc, ids[whole:], part(bearing, whole), whole, len(ids))
                if len(waiting) >= window:
                    settle(False)
                if len(rows) >= 20_000:
                    yield flush()
        settle(True)
        yield flush()

    return pack


def pack_documents(
    docs: DataFrame,
    sequence_tokens: int = SEQUENCE_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss_tokens: int = MAX_LOSS_TOKENS,
    window: int = WINDOW,
    tokenizer: str = TOKENIZER,
    loss_ranges: str | None = None,
) -> DataFrame:
    """One row per piece: which tokens of a document stand where in which sequence.

    A null or empty text is the end token alone; a null id stays null; repeated rows are packed each. Other columns of
    the documents are not read. An empty table gives no rows.

    ``loss_ranges`` names an optional column of (start, end) structs: the code points of the text that bear a loss, end
    exclusive, as the answer behind a prompt. A token bears a loss if it has a byte in a range, the end token if a range
    reaches the end of the text; a null list means all tokens, an empty one none. The limit and the cuts then go by these
    tokens, and ``loss_tokens`` counts them for each piece, without the piece's first token.
    """
    limits = sequence_tokens, max_segments, max_loss_tokens
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if loss_ranges is None:
        return docs.select(*columns).mapInArrow(_packer(limits, window, tokenizer), PIECE)
    ranges = F.col(f"`{loss_ranges}`").cast("array<struct<start: bigint, end: bigint>>").alias("ranges")
    return docs.select(*columns, ranges).mapInArrow(_packer(limits, window, tokenizer, True), LOSS_PIECE)
