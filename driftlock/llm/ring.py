"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of the ring, and a key belongs to the next point clockwise. Shards have a capacity; the
keys beyond the capacity of their shard go on clockwise to the next shard with room. The circle is divided into a fixed
number of cells, and the walk needs only the number of keys per cell: it runs on the driver over that short list,
whatever the size of the table, and gives ranges of key ranks of a cell with their shard and first slot. Rows then
look up the range of their rank. Capacities add up to the number of keys and differ by one at most, so the shards do.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
# Points of the ring per shard.
POINTS = 128
CELLS = 2**14


def cell(key: str, cells: int = CELLS) -> int:
    """The cell of a key, from the first 32 bits of its digest."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) * cells >> 32


def spot(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def owners(shards: int, points: int = POINTS, cells: int = CELLS) -> list[int]:
    """The shard of each cell: that of the next point clockwise; of two points in one cell the smaller shard's."""
    at: dict[int, int] = {}
    for shard in range(shards):
        for point in range(points):
            at.setdefault(cell(f"shard-{shard}-{point}", cells), shard)
    taken = sorted(at)
    return [at[taken[bisect.bisect_left(taken, c) % len(taken)]] for c in range(cells)]


@dataclass(frozen=True)
class Range:
    """Keys of ranks [start, end) of a cell have the slots from ``slot`` on in ``shard``."""

    cell: int
    start: int
    end: int
    shard: int
    slot: int


def walk(counts: list[int], owner: list[int], shards: int) -> list[Range]:
    """Give all keys to shards: first to their own, as far as it has room, then clockwise to the next with room.

    Capacities are the number of keys over the number of shards, one more for the shards that come first.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, given, out = [0] * shards, [0] * len(counts), []

    def give(at: int, shard: int) -> None:
        take = min(counts[at] - given[at], room[shard] - used[shard])
        if take > 0:
            out.append(Range(at, given[at], given[at] + take, shard, used[shard]))
            used[shard] += take
            given[at] += take

    for at in range(len(counts)):
        give(at, owner[at])
    for at in range(len(counts)):
        step = at
        for step in range(at + 1, at + len(counts)):
            if given[at] == counts[at]:
                break
            give(at, owner[step % len(counts)])
        for shard in range(shards):  # shards without any point
            give(at, shard)
    return out


def assign(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, cells: int = CELLS) -> DataFrame:
    """The documents with ``shard`` and ``slot``, which counts from 0 without a gap in each shard.

    The key of a row is its id; rows without an id are spread by their text. Rows of one id lie side by side, ordered
    by their text; of repeated rows each has a slot. Input columns named like the two results are replaced.
    """
    spark = docs.sparkSession
    base = docs.drop("shard", "slot")
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    located = base.withColumn("__spot", spot(key)).withColumn("__cell", F.expr(f"shiftright(__spot * {cells}L, 32)"))
    counted = {r["__cell"]: r["n"] for r in located.groupBy("__cell").agg(F.count("*").alias("n")).collect()}
    plan = walk([counted.get(c, 0) for c in range(cells)], owners(shards, points, cells), shards)
    ranges = spark.createDataFrame(
        [(r.cell, r.start, r.end, r.shard, r.slot) for r in plan], "__cell long, __start long, __end long, __shard int, __slot long"
    )
    order = Window.partitionBy("__cell").orderBy("__spot", "doc_id", F.xxhash64("text"))
    ranked = located.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    # At most a range per cell and one more each time a shard fills up: a fixed bound, so the plan is broadcast.
    return (
        ranked.join(F.broadcast(ranges), "__cell")
        .where((F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__end")))
        .select(*base.columns, F.col("__shard").alias("shard"), (F.col("__slot") + F.col("__rank") - F.col("__start")).alias("slot"))
    )
