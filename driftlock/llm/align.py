"""Which tokens of two tokenizers cover the same text, and how often each pair of ids does so in a corpus.

Both tokenizers give byte lengths, hence cumulative ends. A dictionary from end to index is made for each side, the
hash-set intersection of their keys is sorted, and the common ends slice both id lists into groups of equal bytes. The
last tokens of a slice end together and are linked.

Texts are tokenised once. Documents are gathered into blocks of a bounded number of links; a block keeps its different
id pairs with their counts, and for each document which of them it has. Pairs are summed over blocks, so a pair has at
most one row for each block however frequent it is, and every block gets back the totals of its own pairs. No document
meets another one, and no table of all pairs is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlock.llm.common import stored

BYTE_LEVEL = "byte_bpe_50k"
PIECES = "piece_bpe_32k"
# Links of a block; a document with more is a block of its own.
BLOCK_LINKS = 1 << 19
# Bits of a pair that hold the id of the second tokenizer.
_B_BITS = 20


@lru_cache(maxsize=2)
def byte_level(name: str = BYTE_LEVEL) -> tuple[Callable[[str], list[int]], Callable[[list[int]], bytes], list[bytes]]:
    """(ids of a blank and the text, bytes of ids, bytes of each id), from the rank form of a byte-level vocabulary.

    Strings of special tokens are plain text to it.
    """
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return lambda text: ranked.encode_ordinary(" " + text), ranked.decode_bytes, tokens


@lru_cache(maxsize=2)
def pieces(name: str = PIECES) -> tuple[Callable[[str], list[int]], list[bytes]]:
    """(ids of a text, bytes of each id) of a piece vocabulary, which adds the blank by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        tokens.append(bytes([int(piece[1:-1], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return model.encode, tokens


Group = tuple[list[int], list[int]]


def common_slices(a_ends: list[int], b_ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a and those of b up to each byte place at which both have an end, in order.

    The cumulative ends of either side ascend: no token is without bytes.
    """
    of_a, of_b = (dict(zip(ends, range(1, len(ends) + 1))) for ends in (a_ends, b_ends))
    common = sorted(of_a.keys() & of_b.keys())
    return tuple(np.fromiter(map(of.__getitem__, common), np.int64, len(common)) for of in (of_a, of_b))


class Aligner:
    """Both tokenizers, with the bytes, their number, and the decimal form of every id."""

    def __init__(self, a_name: str = BYTE_LEVEL, b_name: str = PIECES):
        (self.encode_a, self.decode_a, self.bytes_a), (self.encode_b, self.bytes_b) = byte_level(a_name), pieces(b_name)
        self.sizes_a, self.sizes_b = (np.array([*map(len, tokens)], np.int64) for tokens in (self.bytes_a, self.bytes_b))
        # Every id in decimal form, three times: as an inner token of a slice, and as the last one of either side.
        self.shown = np.array([f"{i}{mark}".encode() for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"])

    def slices(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of a, ids of b, where each slice ends among a, and among b); nothing for a text that is null or empty, or
        that either side changes."""
        if not text:
            return None
        a, b = self.encode_a(text), self.encode_b(text)
        raw = b" " + text.encode()
        if self.decode_a(a) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return a, b, *common_slices(np.cumsum(self.sizes_a[a]).tolist(), np.cumsum(self.sizes_b[b]).tolist())

    def groups(self, text: str | None) -> list[Group]:
        """The ids of both sides in each slice."""
        found = self.slices(text)
        if found is None:
            return []
        a, b, ends_a, ends_b = (x.tolist() for x in found)
        return [(a[i:x], b[j:y]) for i, x, j, y in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)]

    def document(self, text: str | None) -> tuple[int, int, int, str, np.ndarray]:
        """(tokens of a, tokens of b, groups, digest of the groups, linked pairs)"""
        found = self.slices(text)
        if found is None:
            return 0, 0, 0, "", np.empty(0, np.int64)
        ids_a, ids_b, ends_a, ends_b = found
        last_a, last_b = ends_a - 1, ends_b - 1
        # The slice of each token: one more behind each end.
        slice_a, slice_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        slice_a[ends_a[:-1]], slice_b[ends_b[:-1]] = 1, 1
        slice_a, slice_b = np.cumsum(slice_a), np.cumsum(slice_b)
        # Both sides of a slice in turn: before a token of a stand the tokens of b in earlier slices, before one of b those
        # of a up to its own slice. Behind the last token of a in a slice comes a bar, behind that of b a semicolon.
        place_a = np.arange(len(ids_a)) + np.r_[0, ends_b][slice_a]
        place_b = np.arange(len(ids_b)) + ends_a[slice_b]
        shown = np.empty(len(ids_a) + len(ids_b), np.int64)
        shown[place_a], shown[place_b] = 3 * ids_a, 3 * ids_b
        shown[place_a[last_a]] += 1
        shown[place_b[last_b]] += 2
        told = self.shown[shown].tobytes().replace(b"\0", b"")
        # The last tokens of each slice are those that end together.
        links = (ids_a[last_a] << _B_BITS) | ids_b[last_b]
        return len(ids_a), len(ids_b), len(ends_a), hashlib.sha256(told[:-1]).hexdigest(), links


_COUNTS = ("id", "n_a", "n_b", "n_groups")
BLOCK = (
    "block bigint, pairs array<bigint>, counts array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in _COUNTS)
    + ", digests array<string>, cuts array<bigint>, which binary, times binary"
)
_longs = pa.list_(pa.int64())
_BLOCK_ARROW = pa.schema(
    [("block", pa.int64()), ("pairs", _longs), ("counts", _longs), *((c, _longs) for c in _COUNTS)]
    + [("digests", pa.list_(pa.string())), ("cuts", _longs), ("which", pa.binary()), ("times", pa.binary())]
)


def _block(number: int, rows: list[tuple], links: list[np.ndarray]) -> dict:
    """One row for a block: its different pairs, and of each document which of them it has how many times."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in links])
    pairs, which, counts = np.unique(np.concatenate(links), return_inverse=True, return_counts=True)
    keys, times = np.unique(owner * max(1, len(pairs)) + which, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(len(rows) + 1) * max(1, len(pairs)))
    columns = dict(zip((*_COUNTS, "digests"), map(list, zip(*rows))))
    return columns | {
        "block": number, "pairs": pairs, "counts": counts, "cuts": cuts,
        "which": (keys % max(1, len(pairs))).astype(np.int32).tobytes(), "times": times.astype(np.int32).tobytes(),
    }


def _blocks(a_name: str, b_name: str, block_links: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        aligner = Aligner(a_name, b_name)
        rows, links, size = [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist([_block(number, rows, links)], _BLOCK_ARROW)
            rows.clear()
            links.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                n_a, n_b, n, digest, linked = aligner.document(text.as_py())
                rows.append((doc, n_a, n_b, n, digest))
                links.append(linked)
                size += n + 1
                if size >= block_links:
                    yield flush()
                    number, size = number + 1, 0
        if rows:
            yield flush()

    return blocks


RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block, with sums over the totals of their pairs."""
    for batch in batches:
        for row in batch.to_pylist():
            which, times = np.frombuffer(row["which"], np.int32), np.frombuffer(row["times"], np.int32).astype(np.int64)
            totals, best = np.array(row["totals"] or [0], np.int64), np.array(row["best"] or [False], bool)
            cuts = np.array(row["cuts"])

            def summed(values: np.ndarray) -> np.ndarray:
                return np.diff(np.r_[0, np.cumsum(values)][cuts])

            sums = summed(times), summed(times * best[which]), summed(times * totals[which])
            columns = [pa.array(row[c], pa.int64()) for c in _COUNTS] + [pa.array(s, pa.int64()) for s in sums]
            names = [c.split()[0] for c in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row["digests"], pa.string())], names=names)


def _tokenised(docs: DataFrame, a: str, b: str, block_links: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return stored(texts.mapInArrow(_blocks(a, b, block_links), BLOCK), "aligned-blocks")


def _asked(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, n): every different pair of every block, by its place there."""
    zipped = F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "p")
    return blocks.select("block", zipped).select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))


def _totals(blocks: DataFrame) -> DataFrame:
    """(pair, total, best): the links that hold a pair, and whether no pair with the same second id has more."""
    totals = stored(_asked(blocks).groupBy("pair").agg(F.sum("n").alias("total")), "pair-totals")
    second = F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("second")
    # One row per id of the second vocabulary at most.
    most = totals.groupBy(second).agg(F.max("total").alias("most"))
    return totals.withColumn("second", second).join(F.broadcast(most), "second").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """(a_id, b_id, links, best): how many links hold a pair, and whether that is the most of its second id; ties all are."""
    told = _totals(_tokenised(docs, a, b, block_links))
    first, second = F.shiftright("pair", _B_BITS), F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1))
    return told.select(first.alias("a_id"), second.alias("b_id"), F.col("total").alias("links"), "best")


def align_documents(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES, block_links: int = BLOCK_LINKS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    ``n_best`` counts the links whose pair is, over all documents, the most frequent one of its second id, ties included;
    ``count_sum`` adds the corpus-wide counts of the pairs of all links. A text that is null or empty, or whose bytes a
    tokenizer doesn't give back with a blank before them, has no tokens: zeros and an empty digest. A null id stays null,
    repeated rows count each. Other columns are not read. An empty table gives no rows.
    """
    blocks = _tokenised(docs, a, b, block_links)
    told = _asked(blocks).select("block", "place", "pair").join(_totals(blocks), "pair")
    answers = told.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "total", "best"))).alias("answer"))
    answers = answers.select("block", F.col("answer.total").alias("totals"), F.col("answer.best").alias("best"))
    # A block without any link has no answer.
    return blocks.drop("pairs", "counts").join(answers, "block", "left").mapInArrow(_finish, RESULT)


def _listed(a_name: str, b_name: str):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_name, b_name)
        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                found = aligner.groups(text.as_py())
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "groups": [{"a": x, "b": y} for x, y in found]}], _GROUPS_ARROW)

    return listed


GROUPS = "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>"
_ids = pa.list_(pa.int32())
_GROUPS_ARROW = pa.schema([("doc_id", pa.int64()), ("groups", pa.list_(pa.struct([("a", _ids), ("b", _ids)])))])


def document_groups(docs: DataFrame, a: str = BYTE_LEVEL, b: str = PIECES) -> DataFrame:
    """(doc_id, groups): the groups themselves, ids of both sides in order. Rows as in ``align_documents``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_listed(a, b), GROUPS)
