"""ST1, ST2: the gate on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftlock.operators.verify import ADDED, CHANGED, IDENTICAL, is_changed, locked_columns, paired
from driftlock.session import scratch_path
from driftlock.sources.buckets import BUCKET, BucketedTable, write_buckets


def batch_verdicts(batch: DataFrame, baseline: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """Verdicts of the rows that are there: JN7 without ``missing``, which a part of the data cannot tell.

    A retyped or missing column is refused, and so is a baseline whose keys repeat; a stream may repeat keys.
    """
    cols = locked_columns(baseline, batch, keys, cols)
    return paired(baseline, batch, keys, cols, how="right", guard=True, guard_new=False).select(
        *[F.col(f"`{k}`") for k in keys],
        F.when(~F.col("in_old"), ADDED)
        .when(is_changed(cols), CHANGED)
        .otherwise(IDENTICAL)
        .alias("status"),
    )


def stored_baseline(baseline: DataFrame, keys: list[str], path: str | None = None, buckets: int | None = None) -> BucketedTable:
    """The baseline in folders by a hash of its keys, for any number of streams. One shuffle, once."""
    path = path or scratch_path(baseline.sparkSession, "stream-baseline")
    return write_buckets(baseline, path, keys, buckets)


def verify_stream(
    stream: DataFrame,
    baseline: DataFrame | BucketedTable,
    keys: list[str],
    out: str,
    checkpoint: str,
    cols: list[str] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """ST1: verdict counts per micro-batch, written under ``out/batch_id=N``.

    A batch that is run again after a failure overwrites its own folder, so counts are exact. The baseline lies in
    folders by a hash of its keys (``stored_baseline``; a DataFrame is stored so first), and a batch opens only the
    folders of its own keys: a small batch reads a small part, whatever the size of the baseline. What is read of it
    is joined by the keys, and broadcast where its bytes allow.
    """
    spark = stream.sparkSession
    if not isinstance(baseline, BucketedTable):
        baseline = stored_baseline(baseline, keys)
    if list(baseline.keys) != list(keys):
        raise ValueError(f"the baseline is stored by {list(baseline.keys)}, not by {list(keys)}")
    # Its folders are listed once.
    whole = baseline.read(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        counts = batch_counts(batch, baseline, whole, cols)
        counts.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def batch_counts(batch: DataFrame, baseline: BucketedTable, whole: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Verdict counts of one batch against the folders that its keys may be in."""
    keys = list(baseline.keys)
    locked_columns(whole.drop(BUCKET), batch, keys, cols)
    verdicts = batch_verdicts(batch, baseline.part(whole, batch), keys, cols)
    return verdicts.groupBy("status").agg(F.count("*").alias("n"))


def verdict_windows(verdicts: DataFrame, time_col: str, width: str, lateness: str) -> DataFrame:
    """ST2: changed and total verdicts per tumbling event-time window; later rows than ``lateness`` are dropped.

    Works on a stream (append mode) and on a batch. ``time_col`` must be a timestamp with time zone.
    """
    return (
        verdicts.withWatermark(time_col, lateness)
        .groupBy(F.window(time_col, width).alias("w"))
        .agg(F.count_if(F.col("status") == CHANGED).alias("changed"), F.count("*").alias("total"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "changed", "total")
    )


def windows_to(verdicts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a parquet folder and stop when the input is used up."""
    return (
        verdicts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
