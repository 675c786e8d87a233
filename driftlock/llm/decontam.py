"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items, normalised, are the patterns. A document is normalised the same way, as bytes: one
table maps capitals to small letters and everything between words to blanks, byte for byte, so a place in the
normalised text is a place in the original. The automaton reads each text once and reports every window at once,
whatever their number. Items are collected, in blocks of bounded size when they are many; the documents never move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 10
# Bytes of benchmark text in one automaton; more text means more passes over the documents, not a larger automaton.
BLOCK_BYTES = 8_000_000

# Byte for byte: capitals become small, every other ASCII byte that is no digit or letter becomes a blank.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(NORMAL).split()


class Windows:
    """The automaton over the windows of items; a text is read as one character per byte."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        held: dict[str, set[int]] = {}
        self.names = [name for name, _ in items]
        for number, (_, text) in enumerate(items):
            words = normal_words(text or "")
            for i in range(max(1, len(words) - window + 1) if words else 0):
                # Blanks at both ends keep a match on whole words.
                key = b" " + b" ".join(words[i : i + window]) + b" "
                held.setdefault(key.decode("latin-1"), set()).add(number)
        self.automaton = ahocorasick.Automaton()
        for key, numbers in held.items():
            self.automaton.add_word(key, (len(key), key.count(" ") - 1, frozenset(numbers)))
        self.any = bool(held)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(number of words, hit runs of words as [from, to), names of the items found)."""
        words = normal_words(text)
        if not words or not self.any:
            return len(words), [], set()
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        found = list(self.automaton.iter(joined))
        if not found:
            return len(words), [], set()
        blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        starts = np.searchsorted(blanks, np.array([end + 1 - size for end, (size, _, _) in found]))
        runs: list[tuple[int, int]] = []
        for a, b in sorted((int(s), int(s) + n) for s, (_, (_, n, _)) in zip(starts, found)):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        return len(words), runs, {self.names[i] for _, (_, _, numbers) in found for i in numbers}


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """The runs of words as code points [start, end) of the text as it was given."""
    raw = text.encode()
    if not runs:
        return []
    inside = np.frombuffer(raw.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[0, inside.view(np.int8), 0]))
    begins, ends = edge[::2], edge[1::2]
    bytes_ = np.frombuffer(raw, np.uint8)
    points = np.r_[0, np.cumsum((bytes_ & 0xC0) != 0x80)]
    return [{"start": int(points[begins[a]]), "end": int(points[ends[b - 1]])} for a, b in runs]


FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_SQL = "struct<n_words: bigint, runs: array<struct<a: bigint, b: bigint>>, spans: array<struct<start: bigint, end: bigint>>, items: array<string>>"
_built: dict[tuple, Windows] = {}


def _scanner(shared, window: int, column: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (shared.id if hasattr(shared, "id") else id(shared), window)
        if key not in _built:
            _built.clear()
            _built[key] = Windows(shared.value, window)
        windows = _built[key]
        for batch in batches:
            texts = batch.column(column)
            out = []
            for text in texts:
                text = text.as_py() or ""
                n, runs, items = windows.scan(text)
                out.append(
                    {"n_words": n, "runs": [{"a": a, "b": b} for a, b in runs], "spans": original_spans(text, runs), "items": sorted(items)}
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, FOUND)], names=[*batch.schema.names, "__found"]
            )

    return scan


def _blocks(items: DataFrame, block_bytes: int) -> list[list[tuple[str, str | None]]]:
    """The items in blocks of at most ``block_bytes`` (an item that is larger stands alone), each fetched by itself."""
    sized = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.col("text"),
        F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"),
    )
    total = sized.agg(F.sum("size").alias("t")).first()["t"] or 0
    count = max(1, -(-int(total) * 2 // block_bytes)) if total > block_bytes else 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(count))
    return [
        [(r["item"], r["text"]) for r in sized.where(part == i).select("item", "text").collect()] for i in range(count)
    ]


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The documents with ``n_words``, ``n_hit``, ``spans`` (code points of the original text), ``items`` (names of
    the items found, sorted as strings) and ``contaminated``.

    A null text, and an item with a null text, has no words. Items that share an id count once; a null id is the empty
    name. Without items nothing is hit. Input columns with the names of results are replaced.
    """
    spark = docs.sparkSession
    results = ["n_words", "n_hit", "spans", "items", "contaminated"]
    base = docs.drop(*[c for c in results if c in docs.columns])
    blocks = _blocks(items, block_bytes)
    found = base
    for block in blocks:
        scan = _scanner(spark.sparkContext.broadcast(block), window, "text")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields)
        found = found.mapInArrow(scan, f"{schema}, __found {_SQL}")
        if "__all" in found.columns:
            one, two = F.col("__all"), F.col("__found")
            both = F.struct(
                two["n_words"].alias("n_words"),
                F.concat(one["runs"], two["runs"]).alias("runs"),
                F.concat(one["spans"], two["spans"]).alias("spans"),
                F.array_union(one["items"], two["items"]).alias("items"),
            )
            found = found.withColumn("__all", both).drop("__found")
        else:
            found = found.withColumnRenamed("__found", "__all")
    # Runs of several blocks may overlap: count the words under their union in one walk.
    walked = F.aggregate(
        F.array_sort("__all.runs"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, r: F.struct(
            (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["end"]))).alias("n"),
            F.greatest(s["end"], r["b"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    return found.select(
        *base.columns,
        F.col("__all.n_words").alias("n_words"),
        walked.alias("n_hit"),
        F.array_sort("__all.spans").alias("spans"),
        F.array_sort("__all.items").alias("items"),
        (F.size("__all.runs") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    """What the query reports of a list of items; used by tests."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
