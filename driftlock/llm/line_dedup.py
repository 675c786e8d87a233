"""Line dedup with a sharded minimal perfect hash.

Lines become 128-bit hashes inside the scan. One aggregation counts the documents of each hash and keeps the largest
document id. The hashes of frequent lines are dealt into shards of bounded size, and each shard becomes one row: a
minimal perfect hash as bit levels, and three arrays that it indexes, fingerprints, counts and owners. Documents send
packed requests (hash, document, place of the line) to the shards and probe the arrays there; only the places of
dropped lines come back. No line is ever joined with another line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlock.llm.common import ascii_lower, stored, strip_space

MIN_CHARS = 20
MIN_DOCS = 3
# Keys of a shard: at 20 bytes a key and a few bits of hash, a shard stays near 5 MB.
SHARD_KEYS = 200_000
# Requests for a shard are spread over so many copies of it, so a line in a third of all documents has as many readers.
COPIES = 16
# Documents per copy of a shard, about: more documents make more shards, so each gets a bounded part of the requests.
COPY_DOCS = 50_000
# Slots of a level for each key that is left.
SPARE = 2.0


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash: on each level, keys that have a slot to themselves stay; the others go on.

    The number of a key is the number of taken slots before its own, so ``n`` keys get the numbers 0 to n - 1. A key
    that was not put in gets any number or none, which is why the arrays hold fingerprints.
    """

    def __init__(self, sizes: list[int], words: list[np.ndarray]):
        self.sizes, self.words = sizes, words
        self.before, total = [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(w) else ones)
            total += int(ones.sum())

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(h1):
            size = -(-max(64, int(len(h1) * SPARE)) // 64) * 64
            slot = (_mixed(h1, h2, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = ~alone[slot]
            h1, h2, level = h1[left], h2[left], level + 1
        return cls(sizes, words)

    def number(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        todo = np.arange(len(h1))
        for level, (size, words) in enumerate(zip(self.sizes, self.words)):
            slot = (_mixed(h1[todo], h2[todo], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[slot >> 6], (slot & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.before[level][slot >> 6] + below)[hit]
            todo = todo[~hit]
        return out


INDEX = "shard int, sizes array<bigint>, bits array<binary>, prints binary, counts binary, owners binary"


def _build(group: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = (group[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    perfect = PerfectHash.build(h1, h2)
    at = perfect.number(h1, h2)
    arrays = {}
    for name, values in (("prints", h2), ("counts", group["n"].to_numpy(np.int64)), ("owners", group["owner"].to_numpy(np.int64))):
        placed = np.empty_like(values)
        placed[at] = values
        arrays[name] = placed.tobytes()
    row = {"shard": int(group["shard"].iloc[0]), "sizes": perfect.sizes, "bits": [w.tobytes() for w in perfect.words]}
    return pd.DataFrame([row | arrays])


class Shard:
    """The arrays of one index row, ready to be probed."""

    def __init__(self, row: dict):
        self.perfect = PerfectHash(row["sizes"], [np.frombuffer(b, np.uint64) for b in row["bits"]])
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts, self.owners = (np.frombuffer(row[c], np.int64) for c in ("counts", "owners"))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold the key, largest of them); 0 documents for a key that the shard doesn't hold."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        at = self.perfect.number(h1, h2)
        known = at >= 0
        known[known] = self.prints[at[known]] == h2[known]
        at = np.where(known, at, 0)
        return np.where(known, self.counts[at], 0), self.owners[at]


REQUEST = "shard int, copy int, ids binary, texts binary, places binary, h1 binary, h2 binary"


def _requests(shards: int, copies: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Most tasks have few batches, so each begins with another copy.
        for number, batch in enumerate(batches, TaskContext.get().partitionId()):
            lists = batch.column("h1")
            length = np.diff(lists.offsets.to_numpy())
            h1, h2 = (batch.column(c).flatten() for c in ("h1", "h2"))
            asked = h1.is_valid().to_numpy(zero_copy_only=False)
            place = np.arange(len(h1)) - np.repeat(np.cumsum(length) - length, length)
            owner = np.repeat(np.arange(len(length)), length)[asked]
            place = place[asked].astype(np.int32)
            a, b = (x.drop_null().to_numpy().view(np.uint64) for x in (h1, h2))
            ids, texts = (batch.column(c).to_numpy() for c in ("id", "text_hash"))
            shard = (a % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            rows = [
                {
                    "shard": int(shard[g[0]]), "copy": number % copies,
                    "ids": ids[owner[g]].tobytes(), "texts": texts[owner[g]].tobytes(), "places": place[g].tobytes(),
                    "h1": a[g].tobytes(), "h2": b[g].tobytes(),
                }
                for g in np.split(order, cuts) if len(g)
            ]
            yield pa.RecordBatch.from_pylist(rows, _REQUEST_ARROW)

    return pack


_REQUEST_ARROW = pa.schema(
    [("shard", pa.int32()), ("copy", pa.int32()), *((c, pa.binary()) for c in ("ids", "texts", "places", "h1", "h2"))]
)
_ANSWER_ARROW = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("places", pa.list_(pa.int32()))])


def _answers(min_docs: int):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by shard and copy, the index row before the requests for it."""
        shard = None
        for batch in batches:
            ids, texts, places = [], [], []
            for row in batch.to_pylist():
                if row["prints"] is not None:
                    shard, held = Shard(row), (row["shard"], row["copy"])
                    continue
                assert shard is not None and held == (row["shard"], row["copy"])
                h1, h2 = (np.frombuffer(row[c], np.uint64) for c in ("h1", "h2"))
                id_ = np.frombuffer(row["ids"], np.int64)
                count, owner = shard.probe(h1, h2)
                drop = np.flatnonzero((count >= min_docs) & (owner != id_))
                ids.append(id_[drop])
                texts.append(np.frombuffer(row["texts"], np.int64)[drop])
                places.append(np.frombuffer(row["places"], np.int32)[drop])
            if not ids:
                continue
            i, t, p = (np.concatenate(x) for x in (ids, texts, places))
            order = np.lexsort((p, t, i))
            i, t, p = i[order], t[order], p[order]
            first = np.flatnonzero(np.r_[True, (np.diff(i) != 0) | (np.diff(t) != 0)][: len(i)])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(i)], pa.int32()), pa.array(p))
            yield pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(t[first]), lists], schema=_ANSWER_ARROW)

    return answer


def line_keys(text: Column) -> Column:
    """The keys of all lines of a text."""
    return F.transform(F.split(text, "\n"), lambda line: ascii_lower(strip_space(line)))


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    long_keys = F.transform(line_keys(text), lambda k: F.when(F.length(k) >= min_chars, k))
    return (
        docs.select(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
            F.xxhash64(text).alias("text_hash"),
            long_keys.alias("keys"),
        )
        .select(
            "id",
            "text_hash",
            F.transform("keys", lambda k: F.when(k.isNotNull(), F.xxhash64(k))).alias("h1"),
            F.transform("keys", lambda k: F.when(k.isNotNull(), F.xxhash64(F.lit(7), k))).alias("h2"),
        )
    )


def build_index(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    shard_keys: int = SHARD_KEYS,
    copies: int = COPIES,
    copy_docs: int = COPY_DOCS,
) -> tuple[DataFrame, int]:
    """(one row per shard, number of shards) over the distinct hashes of lines that ``min_docs`` documents hold."""
    pairs = F.array_distinct(F.filter(F.arrays_zip("h1", "h2"), lambda p: p["h1"].isNotNull()))
    lines = _hashed(docs, min_chars).select("id", F.explode(pairs).alias("p")).select("id", "p.h1", "p.h2")
    counted = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("owner"))
    frequent = stored(counted.where(F.col("n") >= min_docs), "frequent-lines")
    # Enough shards for the keys to fit, and for the documents whose requests a copy of a shard gets.
    shards = max(1, -(-frequent.count() // shard_keys), -(-docs.count() // (copies * copy_docs)))
    # The same unsigned remainder as the requests take: the upper half first, then the carry of 2^64.
    shard = F.pmod(F.pmod(F.col("h1"), F.lit(shards)) + F.when(F.col("h1") < 0, F.lit(2**64 % shards)).otherwise(0), F.lit(shards))
    index = frequent.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(_build, INDEX)
    return stored(index, "line-index"), shards


def dropped_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, copies: int = COPIES
) -> DataFrame:
    """(id, text_hash, places): the places, from 0, of the lines that a document loses."""
    index, shards = build_index(docs, min_chars, min_docs, shard_keys, copies)
    # pmod by a shard without any frequent line: an empty row stands in, so that each request finds a shard.
    spark = docs.sparkSession
    empty = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    rows = (
        empty.join(index, "shard", "left")
        .withColumns({"sizes": F.coalesce("sizes", F.array().cast("array<bigint>")), "bits": F.coalesce("bits", F.array().cast("array<binary>"))})
        .withColumns({c: F.coalesce(F.col(c), F.lit(b"")) for c in ("prints", "counts", "owners")})
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    )
    asked = _hashed(docs, min_chars).mapInArrow(_requests(shards, copies), REQUEST)
    met = rows.unionByName(asked, allowMissingColumns=True)
    answers = (
        met.repartition("shard", "copy")
        .sortWithinPartitions("shard", "copy", F.col("prints").isNull())
        .mapInArrow(_answers(min_docs), "id bigint, text_hash bigint, places array<int>")
    )
    return answers.groupBy("id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with their text less the repeated lines, and the counts ``n_lines`` and ``n_dropped``.

    Every row is a document, also when ids repeat; rows of one id are judged alike. A null id ranks below all others.
    A null text is one empty line and becomes the empty text. Input columns named like the two counts are replaced.
    """
    gone = dropped_lines(docs, **options).select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("places").alias("__places")
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns(
        {"text": text, "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__hash": F.xxhash64(text)}
    )
    lines = F.split("text", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__places")
    left = F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n")
    return (
        keyed.join(gone, ["__id", "__hash"], "left")
        .withColumn("__lines", lines)
        .withColumns(
            {
                "n_lines": F.size("__lines").cast("long"),
                "n_dropped": F.coalesce(F.size("__places"), F.lit(0)).cast("long"),
                "text": F.when(F.col("__places").isNull(), F.col("text")).otherwise(left),
            }
        )
        .select(*docs.columns, *[c for c in ("n_lines", "n_dropped") if c not in docs.columns])
    )
