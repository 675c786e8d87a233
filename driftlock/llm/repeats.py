"""Removal of long repeated passages with a run-length index.

Windows of the given length choose anchors by their content, so equal windows have equal anchors at equal distances,
and only texts around anchors that occur twice can repeat. Equal runs of windows are counted as hashes. Where runs
with one anchor differ, one copy of each goes into an index, with all others of its anchor: a run-compressed
Burrows-Wheeler transform of their concatenation. For the first row of each run of equal letters the index samples the
text place and the common prefix with the row before, for the last row that with the row after. Between sampled places
the common prefix shrinks by one with each step, so one pass over the text streams the matching statistics of every
place against all other places, and a window that matches elsewhere in its full length is marked.

Anchors with very many different runs are split by the bytes that all windows of a short stretch share, their core. The
different bytes of each core are counted, and shards are made for as many. A core that has more than a shard of them
needs no index: it is split into its windows, and those that occur twice are counted as hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlock.llm.anchors import anchor_runs
from driftlock.llm.common import shared_keys, stored
from driftlock.llm.shingles import utf8_parts
from driftlock.operators.lookup import lookup_join

WINDOW = 400
# Bytes of different pieces that a shard of the index holds on average; anchors and cores with more are split.
SHARD_BYTES = 2_000_000
# Bytes of a shard that are indexed at a time, as whole keys; a key that has more is indexed by itself.
INDEX_BYTES = 500_000
# Pairs of places that are compared at a time.
PAIRS = 1 << 16
# Windows of a stretch into which runs of such anchors are split.
STRETCH = 16
NO_ID = -(2**63)
# Stands between texts of an index; no byte of UTF-8.
BETWEEN = 0xFF


class RunLengthIndex:
    """The run-compressed transform of a text, with samples at both ends of every run."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        order = _suffix_order(text)
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # nothing stands before the text
        change = (np.flatnonzero(before[1:] != before[:-1]) + 1).astype(order.dtype)
        head, tail = np.insert(change, 0, 0), np.append(change - 1, order.dtype.type(self.n - 1))
        # The transform itself: a letter and a length per run.
        self.letters, self.lengths = before[head], tail - head + 1
        # Samples: the place of the first and last row of each run, and how far it agrees with the row outside.
        self.head_places, self.tail_places = order[head], order[tail]
        # What the last row of a run shares with the next row, that one shares with it, as the first of the next run.
        between = _agreement(text, order[tail[:-1]], order[head[1:]])
        self.head_agrees, self.tail_agrees = np.insert(between, 0, 0), np.append(between, between.dtype.type(0))

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest string that starts there and also starts at another place."""
        kind = _place_type(self.n)
        here = np.arange(self.n, dtype=kind)
        out = np.zeros(self.n, kind)
        for places, agrees in ((self.head_places, self.head_agrees), (self.tail_places, self.tail_agrees)):
            # A sampled value holds at its place and loses one with each step up to the next sample.
            last = np.full(self.n, -1, kind)
            last[places] = places
            np.maximum.accumulate(last, out=last)
            value = np.zeros(self.n, kind)
            value[places] = agrees
            # Before the first sample the last element is read, and nothing is known.
            value = value[last]
            value -= here
            value += last
            value[last < 0] = 0
            np.maximum(out, value, out=out)
        return out


def _place_type(n: int) -> type:
    """The type of places in a text of ``n`` bytes; four bytes are enough for all but huge ones."""
    return np.int32 if n < 2**31 - 1 else np.int64


def _suffix_order(text: np.ndarray) -> np.ndarray:
    """The places of all suffixes in order: sorted by eight bytes, then by twice as many each round.

    A round sorts only the suffixes that are not yet told apart.
    """
    n = len(text)
    kind = _place_type(n)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    for i in range(8):
        key <<= np.uint64(8)
        key |= padded[i : i + n]
    order = np.argsort(key, kind="stable").astype(kind)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    del key, padded
    head = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), 0))
    rank = np.empty(n + 1, kind)
    rank[order], rank[n] = head, -1
    del head
    step = 8
    alone = new & np.r_[new[1:], True]
    slots = np.flatnonzero(~alone).astype(kind)
    while len(slots):
        places = order[slots]
        group = rank[places]
        follow = rank[np.minimum(places.astype(np.int64) + step, n)] + 1
        by = np.argsort(group * np.int64(n + 2) + follow, kind="stable")
        places, group, follow = places[by], group[by], follow[by]
        order[slots] = places
        new = np.r_[True, (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])]
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[places] = first
        slots = slots[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


def _agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes of the suffixes at ``a`` and ``b``."""
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    out = np.zeros(len(a), _place_type(len(text)))
    for at in range(0, len(a), PAIRS):
        out[at : at + PAIRS] = _agreement_of(words, len(text), a[at : at + PAIRS], b[at : at + PAIRS])
    return out


def _agreement_of(words: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    while len(todo):
        x, y = a[todo] + out[todo], b[todo] + out[todo]
        room = n - np.maximum(x, y)
        inside = room > 0
        todo, x, y, room = todo[inside], x[inside], y[inside], room[inside]
        if not len(todo):
            break
        differ = words[x] != words[y]
        some = differ.any(axis=1)
        same = np.minimum(np.where(some, differ.argmax(axis=1), 8), room)
        out[todo] += same
        todo = todo[~some & (same == 8)]
    return out


def repeated_windows(texts: list[bytes], window: int) -> list[np.ndarray]:
    """For each of the different ``texts``, the starts of the windows that also occur at another place among them."""
    joined = np.frombuffer(bytes([BETWEEN]).join(texts) + bytes([BETWEEN]), np.uint8)
    long_ = RunLengthIndex(joined).matching_statistics() >= window
    out, at = [], 0
    for text in texts:
        out.append(np.flatnonzero(long_[at : at + max(0, len(text) - window + 1)]))
        at += len(text) + 1
    return out


def _ranges(places: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of neighbours as first places and numbers of places."""
    if not len(places):
        return [], []
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    first, last = np.r_[places[0], places[cut]], np.r_[places[cut - 1], places[-1]]
    return first.tolist(), (last - first + 1).tolist()


# A place holds the first window of a run, the distance to its anchor and the number of windows.
_DISTANCE, _COUNT = 10, 10
RUN = "h bigint, c bigint, id bigint, th bigint, place bigint"
_RUN_NAMES = ["h", "c", "id", "th", "place"]


def _packed(start, distance, count):
    return (start << (_DISTANCE + _COUNT)) | (distance << _COUNT) | count


def _unpacked(place):
    return place >> (_DISTANCE + _COUNT), (place >> _COUNT) & ((1 << _DISTANCE) - 1), place & ((1 << _COUNT) - 1)


def _find_runs(window: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_parts(batch.column("text"))
            ids, hashes = (batch.column(c).to_numpy() for c in ("id", "th"))
            for text, h, c, start, distance, count in anchor_runs(raw, offsets, window):
                columns = [h.view(np.int64), c.view(np.int64), ids[text], hashes[text], _packed(start, distance, count)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_RUN_NAMES)

    return find


PIECE = "key bigint, u bigint, h bigint, c bigint, off int, n int, bytes binary"
_PIECE_ARROW = pa.schema(
    [("key", pa.int64()), ("u", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("off", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())]
)


def _cut(window: int, stretch: int):
    """The bytes of chosen runs; of runs of split anchors, the bytes of each stretch of windows."""

    def parts(h: int, place: int, split: bool) -> list[tuple[int, int, int, int]]:
        start, distance, count = _unpacked(place)
        if not split:
            return [(start, 0, count, h)]
        out, off = [], 0
        while off < count:
            # Stretches are aligned by the distance to the anchor, which is the same for equal windows.
            ahead = distance - off
            n = min(count - off, ahead % stretch + 1)
            out.append((start + off, off, n, ahead // stretch))
            off += n
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                raw = text.as_py().encode()
                for run in runs.as_py():
                    for at, off, n, extra in parts(run["h"], run["place"], run["split"]):
                        bytes_ = raw[at : at + n + window - 1]
                        if run["split"]:
                            # What every window of the stretch has, were it whole.
                            ahead = _unpacked(run["place"])[1] - off
                            low = at + ahead - extra * stretch
                            core = raw[low : low + window - stretch + 1]
                            key = xxhash.xxh3_64_intdigest(core, seed=extra)
                        else:
                            key = run["h"] & (2**64 - 1)
                        u = xxhash.xxh3_64_intdigest(bytes_, seed=key) - 2**63
                        rows.append((key - 2**63, u, run["h"], run["c"], off, n, bytes_))
                if len(rows) > 20_000:
                    yield _piece_batch(rows)
                    rows = []
            yield _piece_batch(rows)

    return cut


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(_PIECE_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE_ARROW)], schema=_PIECE_ARROW)


def _blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours that have at most ``most`` together, as ranges; one that has more is a block of its own."""
    upto, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - sizes[at] + most, "right")))
        yield at, end
        at = end


def _index(window: int):
    def index(group: pd.DataFrame) -> pd.DataFrame:
        # Equal windows have equal keys, so an index of whole keys finds all matches of its windows.
        group = group.sort_values("key", kind="stable")
        keys, first = np.unique(group["key"].to_numpy(), return_index=True)
        bounds, texts = np.r_[first, len(group)], group["bytes"].tolist()
        sizes = np.add.reduceat([len(t) + 1 for t in texts], first)
        ranges = []
        for a, b in _blocks(sizes, INDEX_BYTES):
            ranges += [_ranges(f) for f in repeated_windows(texts[bounds[a] : bounds[b]], window)]
        # A stretch that several runs have repeats as a whole.
        for i, many in enumerate(group["copies"].to_numpy() > 1):
            if many:
                ranges[i] = ([0], [int(group["n"].iloc[i])])
        out = pd.DataFrame({"key": group["key"], "u": group["u"], "firsts": [r[0] for r in ranges], "counts": [r[1] for r in ranges]})
        return out[[len(r[0]) > 0 for r in ranges]]

    return index


ONE = "key bigint, u bigint, copies bigint, first int, low bigint, high bigint"


def _windows(window: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of stretches as hashes of 128 bits."""
        for batch in batches:
            places, firsts, hashes = [], [], []
            for i, piece in enumerate(batch.column("bytes")):
                raw = piece.as_py()
                for first in range(len(raw) - window + 1):
                    places.append(i)
                    firsts.append(first)
                    hashes.append(xxhash.xxh3_128_digest(raw[first : first + window]))
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            kept = batch.select(["key", "u", "copies"]).take(pa.array(places, pa.int64()))
            columns = [*kept.columns, pa.array(firsts, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept.schema.names, "first", "low", "high"])

    return windows


def _different(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("key", "u").agg(F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bytes").alias("bytes"))


def _marks(pieces: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(key, u, firsts, counts): the repeated windows of each different piece, as ranges.

    Equal windows have equal keys. Keys with at most a shard of different bytes are dealt to indexes, the others are
    split into windows.
    """
    size = (F.col("n") + F.lit(window)).cast("long")
    sizes = pieces.select("key", "u", "n").distinct().groupBy("key").agg(F.sum(size).alias("size"))
    sizes = stored(sizes, "cores")
    large = F.col("size") > shard_bytes
    told = sizes.agg(F.sum(F.when(~large, F.col("size"))).alias("small"), F.count_if(large).alias("large")).first()
    shards = max(1, -(-int(told["small"] or 0) // shard_bytes))
    if told["large"]:
        flagged = lookup_join(pieces, sizes.where(large).select("key", F.lit(True).alias("large")), ["key"])
        small, rest = flagged.where("large is null").drop("large"), flagged.where("large").drop("large")
    else:
        small, rest = pieces, None
    indexed = _different(small).withColumn("shard", F.pmod("key", F.lit(shards)))
    kind = "key bigint, u bigint, firsts array<int>, counts array<int>"
    marks = indexed.groupBy("shard").applyInPandas(_index(window), kind)
    if rest is None:
        return marks
    single = stored(_different(rest).select("key", "u", "copies", "bytes").mapInArrow(_windows(window), ONE), "windows")
    twice = single.groupBy("low", "high").agg(F.sum("copies").alias("total")).where("total > 1").select("low", "high")
    found = lookup_join(single, stored(twice, "repeated-windows"), ["low", "high"], how="inner")
    firsts = found.groupBy("key", "u").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    return marks.unionByName(firsts.withColumn("counts", F.transform("firsts", lambda _: F.lit(1))))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__th": F.xxhash64(text)})


def repeated_runs(docs: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, stretch: int = STRETCH) -> DataFrame:
    """(id, th, spans): for each document with repeated windows, their runs as (first, count)."""
    texts = _keyed(docs).select(F.col("__id").alias("id"), F.col("__th").alias("th"), "text")
    runs = texts.where(F.octet_length("text") >= window).mapInArrow(_find_runs(window), RUN)
    live = stored(runs.repartition("h").sortWithinPartitions("h").mapInArrow(shared_keys, RUN), "runs")
    units = stored(
        live.groupBy("h", "c").agg(F.count("*").alias("copies"), *[F.first(x).alias(x) for x in ("id", "th", "place")]), "units"
    )
    size = (F.col("place").bitwiseAND(F.lit((1 << _COUNT) - 1)) + window - 1).cast("long")
    anchors = units.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(size).alias("size")).where("kinds > 1")
    anchors = stored(anchors.select("h", "size", (F.col("size") > shard_bytes).alias("split")), "anchors")
    chosen = stored(units.join(anchors.select("h", "split"), "h").select("id", "th", "h", "c", "place", "split"), "chosen")
    needed = lookup_join(texts, chosen.select("id", "th").distinct(), ["id", "th"], how="inner")
    listed = chosen.groupBy("id", "th").agg(F.collect_list(F.struct("h", "c", "place", "split")).alias("runs"))
    # Repeated rows of the table are one source of bytes.
    sources = needed.join(listed, ["id", "th"]).dropDuplicates(["id", "th"]).select("text", "runs")
    pieces = stored(sources.mapInArrow(_cut(window, stretch), PIECE), "pieces")
    marks = _marks(pieces, window, shard_bytes)
    found = (
        pieces.select("key", "u", "h", "c", "off")
        .join(marks, ["key", "u"])
        .select("h", "c", F.transform(F.arrays_zip("firsts", "counts"), lambda r: F.struct((r["firsts"] + F.col("off")).alias("first"), r["counts"].alias("count"))).alias("spans"))
        .groupBy("h", "c")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    # A run with copies repeats as a whole; of the others what the index has found.
    count = F.col("place").bitwiseAND(F.lit((1 << _COUNT) - 1)).cast("int")
    whole = units.where("copies > 1").select("h", "c", F.array(F.struct(F.lit(0).alias("first"), count.alias("count"))).alias("spans"))
    single = found.join(units.where("copies = 1").select("h", "c"), ["h", "c"])
    marked = stored(whole.unionByName(single), "marked-runs")
    start = F.shiftright("place", _DISTANCE + _COUNT)
    placed = live.join(marked, ["h", "c"]).select(
        "id", "th", F.transform("spans", lambda s: F.struct((s["first"] + start).alias("first"), s["count"].cast("long").alias("count"))).alias("spans")
    )
    return placed.groupBy("id", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


REMOVED = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column("text"), batch.column("__spans")):
                raw = text.as_py().encode()
                table = np.array([[s["first"], s["count"]] for s in spans.as_py() or []], np.int64).reshape(-1, 2)
                a, b = table[:, 0], table[:, 0] + table[:, 1] - 1 + window
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order]) if len(a) else b
                new = np.r_[True, a[1:] > b[:-1]][: len(a)]
                first, last = a[new], b[np.r_[np.flatnonzero(new)[1:] - 1, len(a) - 1]] if len(a) else b
                edges = [0, *np.c_[first, last].ravel().tolist(), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2]))
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(first), kept)):
                    column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.binary())]
            kept_names = [c for c in batch.schema.names if c not in ("text", "__spans")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept_names], *arrays], names=[*kept_names, "n_bytes", "n_removed", "n_spans", "kept"])

    return remove


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the documents without their repeated passages, as bytes.

    A null text is empty. Rows are documents, also when ids or whole rows repeat: equal rows repeat each other. Texts
    shorter than a window keep all. Other columns are not read.
    """
    window = options.get("window", WINDOW)
    keyed = _keyed(docs).select("doc_id", "text", "__id", "__th")
    spans = stored(repeated_runs(docs, **options), "spans")
    ids = spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.lit(True).alias("__hit"))
    told = lookup_join(keyed, ids, ["__id", "__th"])
    raw = F.col("text").cast("binary")
    zero = F.lit(0).cast("long")
    clean = told.where("__hit is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), raw.alias("kept")
    )
    hit = told.where("__hit").join(spans.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("spans").alias("__spans")), ["__id", "__th"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = hit.select("doc_id", "text", "__spans").mapInArrow(_remove(window), f"doc_id {kind}, {REMOVED}")
    return clean.unionByName(cut)
