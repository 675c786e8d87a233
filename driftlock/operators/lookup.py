"""Look-up joins that survive hot keys and size their broadcasts."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# A key is hot when it owns more than this share of the rows; at most 1 / share keys can be hot.
HOT_SHARE = 1 / 512
HOT_SALTS = 64
# Sides up to this many narrow rows are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> list[tuple]:
    """Keys that own more than ``share`` of the rows: fewer than 1 / share of them, so a list is safe.

    One job: the rows are counted in passing, and only the 1 / share most frequent keys can qualify.
    """
    seen = Observation()
    counts = df.observe(seen, F.count(F.lit(1)).alias("rows")).groupBy(*keys).agg(F.count("*").alias("__n"))
    top = counts.orderBy(F.desc("__n")).limit(ceil(1 / share)).collect()
    floor = seen.get["rows"] * share + 1
    return [tuple(r)[:-1] for r in top if r["__n"] > floor]


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    how: str = "left",
    salts: int = HOT_SALTS,
    share: float = HOT_SHARE,
    broadcast_rows: int = BROADCAST_ROWS,
    lookup_rows: int | None = None,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Join ``big`` to ``lookup``, which has at most one row per key, splitting hot keys of ``big``.

    A look-up of counted, small size is broadcast. Beyond that both sides are shuffled: rows of a hot key are
    spread over ``salts`` partitions and its single look-up row is repeated for each; other keys are joined as
    they are. A caller that knows the size of the look-up or the ``hot`` keys of ``big`` may pass them.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    if lookup_rows is None:
        lookup_rows = lookup.limit(broadcast_rows + 1).count()
    if lookup_rows <= broadcast_rows:
        return big.join(F.broadcast(lookup), keys, how)
    if hot is None:
        hot = hot_keys(big, keys, share)
    if not hot:
        return big.join(lookup, keys, how)
    marks = big.sparkSession.createDataFrame(hot, big.select(*keys).schema).withColumn("__hot", F.lit(True))
    spread = F.when(
        F.col("__hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")
    ).otherwise(0)
    left = big.join(F.broadcast(marks), keys, "left").withColumn("__salt", spread).drop("__hot")
    copies = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = (
        lookup.join(F.broadcast(marks), keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
