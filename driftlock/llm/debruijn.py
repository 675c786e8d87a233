"""Removal of long repeated passages with a compacted De Bruijn graph over words.

A token k-mer is a window of k words: an edge from the node of its first k - 1 words to that of its last k - 1. Windows
choose an anchor by their content, the gram with the least hash, so equal windows have equal anchors at equal distances,
and neighbours with one anchor form a run. Only runs whose anchor occurs twice can hold a repeated edge; all others end
there, which is most of a corpus. Equal runs are one source with a number of copies. A run without a rival, a different
run with the same anchor, is one edge of the graph as a whole; runs with rivals are split into their k-mers.

Texts are stored once in blocks, as a table bucketed by block, and are never shuffled: what joins find out is sent to the
blocks. Edges with two occurrences are kept. A node with one edge in and one edge out does not branch, and the two are glued by
a join over nodes. Glued edges that follow each other at their source coordinates (the least document and word that has
them) are one path at once; the few links between paths of different sources are followed by joins that double their
reach each round. Every run then knows its stretches of paths, every document looks its runs up, and spans are merged
along a path. A span is removed only if its edges have a second source coordinate, and edges are equal only if 128 bits
agree at both.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from driftlock.llm.anchors import _least
from driftlock.llm.common import stored
from driftlock.llm.shingles import _joined
from driftlock.operators.lookup import HOT_SALTS, HOT_SHARE
from driftlock.session import scratch_path

WINDOW = 35
# Words of the grams among which a window chooses its anchor.
GRAM = 8
# Bytes of text of a block, unless one text has more, and windows that a task looks at together.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1 << 14
WINDOWS = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)

_hash = xxhash.xxh3_64_intdigest


def _signed(hashes) -> np.ndarray:
    return np.fromiter(hashes, np.uint64).view(np.int64)


class Words:
    """The words of some texts, joined by single blanks."""

    def __init__(self, texts: list[bytes]):
        lists = [t.split() for t in texts]  # at blank, tab, line feed, vertical tab, form feed, carriage return
        self.flat = [w for words in lists for w in words]
        self.counts = np.array([len(words) for words in lists], np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.joined = memoryview(b" ".join(self.flat))
        lengths = np.fromiter(map(len, self.flat), np.int64, len(self.flat))
        # Where each word begins, and one place behind a blank after the last.
        self.begin = np.r_[0, np.cumsum(lengths + 1)]

    def hashes(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """The hash of each stretch of words, of their own bytes."""
        ends = self.begin[first + size] - 1
        return _signed(_hash(self.joined[a:b]) for a, b in zip(self.begin[first].tolist(), ends.tolist()))


def anchor_runs(words: Words, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(number of the text, anchor hash, first window in all words, windows) of the runs of all texts."""
    hashes = np.fromiter(map(_hash, words.flat), np.uint64, len(words.flat))
    owner = np.repeat(np.arange(len(words.counts)), words.counts)
    for at in range(0, len(hashes) - window + 1, WINDOWS):
        part = hashes[at : at + WINDOWS + window - 1]
        own = owner[at : at + WINDOWS + window - 1]
        grams = _joined(part, gram)
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        chosen = (_least(keys, window - gram + 1) & _PLACE).astype(np.int64)
        # Windows that lie within one text.
        inside = np.flatnonzero(own[: len(chosen)] == own[window - 1 :])
        if not len(inside):
            continue
        chosen, text = chosen[inside], own[inside]
        first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])])
        count = np.diff(np.r_[first, len(inside)])
        yield text[first], grams[chosen[first]], at + inside[first], count


def _blocks(kind: pa.DataType):
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(kind)), ("texts", pa.list_(pa.string()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        parts: list[pa.RecordBatch] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            columns = [table.column(c).combine_chunks() for c in ("doc_id", "text")]
            lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), c) for c in columns]
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], schema=schema)

        for batch in batches:
            lengths = np.array([len(t.as_buffer()) for t in batch.column("text")], np.int64)
            first = 0
            for i, n in enumerate(lengths.tolist()):
                if rows and (size + n > BLOCK_BYTES or rows >= BLOCK_ROWS):
                    parts.append(batch.slice(first, i - first))
                    yield flush()
                    first, size, rows, number = i, 0, 0, number + 1
                size, rows = size + n, rows + 1
            parts.append(batch.slice(first))
        if rows:
            yield flush()

    return blocks


def _stored_blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, texts): documents in blocks of bounded text, stored where they are read, bucketed by block.

    A join with rows that are dealt by block does not move the texts.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType
    shape = f"block bigint, ids array<{kind.simpleString()}>, texts array<string>"
    name, buckets = f"blocks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.mapInArrow(_blocks(to_arrow_type(kind)), shape)
    writer = rows.write.format("parquet").bucketBy(buckets, "block").option("path", scratch_path(spark, "word-blocks"))
    writer.saveAsTable(name)
    return spark.table(name)


# A place holds the row in its block, the first window of a run and the number of windows.
_START_BITS, _COUNT_BITS = 34, 8
RUN = "h bigint, c bigint, block bigint, place bigint"


def _find_runs(window: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column("block").to_pylist(), batch.column("texts")):
                words = Words([t.as_py() for t in texts.values.cast(pa.large_binary())])
                for text, h, first, count in anchor_runs(words, window, gram):
                    c = words.hashes(first, count + window - 1)
                    place = (((text << _START_BITS) | (first - words.firsts[text])) << _COUNT_BITS) | count
                    columns = [h.view(np.int64), c, np.full(len(h), block), place]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["h", "c", "block", "place"])

    return find


def _unpacked(place: int) -> tuple[int, int, int]:
    """(row, first window, number of windows)"""
    start = place >> _COUNT_BITS
    return start >> _START_BITS, start & ((1 << _START_BITS) - 1), place & ((1 << _COUNT_BITS) - 1)


# ``at`` tells a source coordinate as one number, which is enough to see what follows what: bits of the document's hash,
# the word, and the number of windows.
_AT_WORD, _AT_COUNT = 22, 5
EDGE = "h bigint, c bigint, i int, n int, u bigint, f bigint, t bigint, copies bigint, at bigint"
_EDGE_NAMES = [c.split()[0] for c in EDGE.split(", ")]


def _cut_edges(window: int):
    """The edges of chosen runs with their nodes, read at the source coordinates."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts, runs in zip(batch.column("block").to_pylist(), batch.column("texts"), batch.column("runs").to_pylist()):
                words = Words([t.as_py() for t in texts.values.cast(pa.large_binary())])
                out: list[tuple] = []
                for run in runs:
                    row, start, count = _unpacked(run["place"])
                    places = np.arange(count + 1) + (start + words.firsts[row])
                    h, c, copies = run["h"], run["c"], run["copies"]
                    doc = _hash(b"%d %d" % (block, row)) >> 37
                    at = (doc << (_AT_WORD + _AT_COUNT)) | (start % (1 << _AT_WORD) << _AT_COUNT)
                    if run["rivals"]:
                        nodes = words.hashes(places, window - 1).tolist()
                        edges = (words.hashes(places[:-1], window) ^ np.int64(h)).tolist()
                        out += [(h, c, i, 1, edges[i], nodes[i], nodes[i + 1], copies, at + (i << _AT_COUNT) + 1) for i in range(count)]
                    else:
                        f, t = words.hashes(places[[0, -1]], window - 1).tolist()
                        out.append((h, c, 0, count, c ^ h, f, t, copies, at + count))
                columns = [pa.array(x, pa.int32() if name in "in" else pa.int64()) for name, x in zip(_EDGE_NAMES, zip(*out))]
                yield pa.RecordBatch.from_arrays(columns, names=_EDGE_NAMES)

    return cut


def _hot(counts: DataFrame, column: str, n: str) -> list[int]:
    """Keys that own more than a share of all rows; fewer than its inverse can."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(n) > total * HOT_SHARE + 1).select(column).distinct().collect()]


def _met(big: DataFrame, lookup: DataFrame, keys: list[str], column: str, hot: list[int]) -> DataFrame:
    """The rows of ``big`` with their look-up row, if there is one. Rows of hot keys are spread, their look-up rows repeated."""
    if not hot:
        return big.join(lookup, keys)
    is_hot = F.col(column).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(*big.columns), F.lit(HOT_SALTS)).cast("int")).otherwise(0)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("salt", salt).join(lookup.withColumn("salt", F.explode(salts)), [*keys, "salt"]).drop("salt")


def _live_runs(blocks: DataFrame, window: int, gram: int) -> DataFrame:
    """The runs whose anchor occurs twice, one row per occurrence."""
    runs = stored(blocks.select("block", "texts").mapInArrow(_find_runs(window, gram), RUN), "runs")
    anchors = stored(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    return stored(_met(runs, anchors.select("h"), ["h"], "h", _hot(anchors, "h", "n")), "live-runs")


def _edges(blocks: DataFrame, kinds: DataFrame, window: int) -> DataFrame:
    """(h, c, i, n, u, f, t, copies, at): the edges of one source of each different run."""
    anchors = stored(kinds.groupBy("h").agg(F.count("*").alias("n")), "run-kinds")
    flagged = _met(kinds, anchors.select("h", (F.col("n") > 1).alias("rivals")), ["h"], "h", _hot(anchors, "h", "n"))
    run = F.struct("h", "c", "s.place", "copies", "rivals")
    listed = flagged.groupBy("s.block").agg(F.collect_list(run).alias("runs"))
    return stored(blocks.select("block", "texts").join(listed, "block").mapInArrow(_cut_edges(window), EDGE), "edges")


def _paths(edges: DataFrame) -> tuple[DataFrame, list[int]]:
    """(u, path) of all repeated edges, the path being named by one of its edges, and the edges that very many runs have."""
    sums = F.sum("copies").alias("copies"), F.count("*").alias("runs")
    repeated = edges.groupBy("u").agg(*sums, F.min("at").alias("at"), F.min("f").alias("f"), F.min("t").alias("t"))
    repeated = stored(repeated.where("copies > 1"), "repeated-edges")
    alone = F.count("*") == 1
    out = repeated.groupBy(F.col("f").alias("node")).agg(F.min("u").alias("u"), alone.alias("one")).where("one")
    into = repeated.groupBy(F.col("t").alias("node")).agg(F.min("u").alias("prev"), alone.alias("one")).where("one")
    glue = out.join(into, "node").where("u <> prev").select("u", "prev")
    placed = repeated.select("u", F.shiftright("at", _AT_WORD + _AT_COUNT).alias("doc"), "at").join(glue, "u", "left")
    along = Window.partitionBy("doc").orderBy("at", "u")
    # Where the edge before ends: as many words on as it has windows.
    n = F.lag("at").over(along).bitwiseAND(F.lit((1 << _AT_COUNT) - 1))
    ends = F.shiftright(F.lag("at").over(along), _AT_COUNT) + n
    before = (F.lag("u").over(along) == F.col("prev")) & (ends == F.shiftright("at", _AT_COUNT))
    heads = placed.withColumn("head", ~F.coalesce(before, F.lit(False)))
    stretch = F.last(F.when(F.col("head"), F.col("u")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    stretches = stored(heads.withColumn("stretch", stretch).select("u", "prev", "head", "stretch"), "stretches")
    # Glued edges with different sources: the end of one stretch and the head of another.
    tails = stretches.where("head and prev is not null").select(F.col("prev").alias("u"), F.col("stretch").alias("to"))
    links = tails.join(stretches.select("u", F.col("stretch").alias("from")), "u").where("`from` <> to").select("to", "from")
    first = _first_stretches(stored(links, "stretch-links"))
    # A chain is no longer than its documents together; the stretches of one are no hot key.
    joined = stretches.select("u", "stretch").join(first, "stretch", "left").select("u", F.coalesce("first", "stretch").alias("path"))
    return stored(joined, "paths"), _hot(repeated, "u", "runs")


def _first_stretches(links: DataFrame) -> DataFrame:
    """(stretch, first) for stretches that follow another one: where their chain begins.

    A stretch follows one other at most, and one at most follows it, so links are chains and cycles. Every round doubles
    how far back a stretch looks, until all look at a beginning; what doesn't after as many doublings as the number of
    links has bits is a cycle, which is named by its least member.
    """
    ahead = links.select(F.col("to").alias("stretch"), F.col("from").alias("at"), F.least("to", "from").alias("least"))
    begins = links.select(F.col("from").alias("at")).join(links.select(F.col("to").alias("at")), "at", "left_anti")
    walk = stored(ahead.join(begins.withColumn("done", F.lit(True)), "at", "left").withColumn("done", F.coalesce("done", F.lit(False))), "chains")
    finished = [walk.where("done")]
    open_ = walk.where("not done")
    for _ in range(links.count().bit_length() + 1):
        if open_.isEmpty():
            break
        there = walk.select(F.col("stretch").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"), "done")
        # A stretch that still looks at another is the only one to do so.
        step = open_.drop("done").join(there, "at").select("stretch", F.col("next").alias("at"), F.least("least", "other").alias("least"), "done")
        step = stored(step, "chains")
        finished.append(step.where("done"))
        open_ = step.where("not done")
        walk = reduce(DataFrame.unionByName, [open_, *finished])
    first = F.when(F.col("done"), F.col("at")).otherwise(F.col("least"))
    return stored(reduce(DataFrame.unionByName, [open_, *finished]).select("stretch", first.alias("first")), "chain-beginnings")


def _merged(entries: Column) -> Column:
    """Neighbouring entries (i, n, path) of a run that lie on one path become one; a run has few."""
    nothing = F.array().cast("array<struct<i: int, n: int, path: bigint>>")

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        follows = (last["path"] == x["path"]) & (last["i"] + last["n"] == x["i"])
        longer = F.struct(last["i"].alias("i"), (last["n"] + x["n"]).alias("n"), x["path"].alias("path"))
        others = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(follows, F.concat(others, F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(entries, nothing, add)


def _block_runs(blocks: DataFrame, window: int, gram: int) -> DataFrame:
    """(block, runs): for each block with repeated edges, its runs as (place, entries on paths)."""
    live = _live_runs(blocks, window, gram)
    source = F.min(F.struct("block", "place")).alias("s")
    kinds = stored(live.groupBy("h", "c").agg(F.count("*").alias("copies"), source), "different-runs")
    edges = _edges(blocks, kinds, window)
    paths, hot = _paths(edges)
    found = _met(edges.select("h", "c", "i", "n", "u"), paths, ["u"], "u", hot)
    entries = found.groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("i", "n", "path"))).alias("entries"))
    marked = stored(entries.select("h", "c", _merged(F.col("entries")).alias("entries")), "marked-runs")
    placed = _met(live, marked, ["h", "c"], "c", _hot(kinds, "c", "copies"))
    return placed.groupBy("block").agg(F.collect_list(F.struct("place", "entries")).alias("runs"))


def merged_spans(edges: list[tuple[int, int, int]], window: int) -> list[tuple[int, int, int]]:
    """(first word, words, path) of a document: neighbouring edges (first window, windows, path) of one path are one span."""
    spans: list[list[int]] = []
    for first, n, path in sorted(edges):
        if spans and spans[-1][2] == path and spans[-1][0] + spans[-1][1] == first:
            spans[-1][1] += n
        else:
            spans.append([first, n, path])
    return [(first, n + window - 1, path) for first, n, path in spans]


SPANS = "spans array<struct<first: bigint, words: bigint, path: bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("path", pa.int64())]))
REMOVED = f"n_words bigint, n_removed bigint, kept string, {SPANS}"


def _remove(window: int, kind: pa.DataType):
    schema = pa.schema(
        [("doc_id", kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", _SPANS_ARROW)]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts, runs in zip(batch.column("ids"), batch.column("texts"), batch.column("runs").to_pylist()):
                edges: list[list] = [[] for _ in range(len(texts))]
                for run in runs or []:
                    row, start, _ = _unpacked(run["place"])
                    edges[row] += [(start + x["i"], x["n"], x["path"]) for x in run["entries"]]
                out: list[list] = [[], [], [], []]
                for text, found in zip(texts.values.cast(pa.large_binary()), edges):
                    words = text.as_py().split()
                    spans = merged_spans(found, window)
                    # Spans of different paths may overlap; their first words ascend.
                    kept, upto = [], 0
                    for first, size, _ in spans:
                        kept += words[upto:first]
                        upto = max(upto, first + size)
                    kept += words[upto:]
                    listed = [{"first": a, "words": n, "path": p} for a, n, p in spans]
                    for column, value in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode(), listed)):
                        column.append(value)
                columns = [pa.array(v, f.type) for v, f in zip(out, list(schema)[1:])]
                yield pa.RecordBatch.from_arrays([ids.values, *columns], schema=schema)

    return remove


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans): the documents without the words of repeated windows, joined by blanks.

    Words stand between white space (blank and 0x09 to 0x0D). A null text has none. Rows are documents, also when ids or
    whole rows repeat: equal rows repeat each other. Documents with fewer words than a window keep all. ``spans`` tells
    what was found: (first word, words, path), where ``path`` names the compacted path of the graph; spans of several
    documents with one path are the same passage or parts of it. Other columns are not read. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType
    blocks = _stored_blocks(docs)
    runs = _block_runs(blocks, window, gram)
    return blocks.join(runs, "block", "left").mapInArrow(_remove(window, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, {REMOVED}")
