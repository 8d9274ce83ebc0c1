"""Streaming forms: daily rollup, keep-last upsert, realized accuracy so far."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from seriesloom.functions.timecols import MICROS_PER_DAY, micros
from seriesloom.operators.prepare import keep_last
from seriesloom.operators.realized import compare
from seriesloom.session import scratch_folder, stored_table


def daily_rollup(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(series_id, ts, y) events to one row per series and day. State per open day is
    one partial aggregate per series; rows later than ``lateness`` are dropped.

    ``ts`` is wall-clock time. Days are cut on it whatever the session time zone is.
    """
    stamped = events.withColumn("ts", F.timestamp_micros(micros(F.col("ts"))))
    day = F.date_from_unix_date(F.floor(F.unix_micros("day.start") / MICROS_PER_DAY).cast("int"))
    return stamped.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day").alias("day"), "series_id").agg(
        F.sum("y").alias("y"), F.count("*").alias("readings")
    ).select("series_id", day.alias("ds"), "y", "readings")


def write_rollup(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return rollup.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _set_down(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table of their own: a checkpoint of rows takes several times the disk."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def merge_latest(batch: DataFrame, path: str, key: Sequence[str], order: Sequence[str], partition: str) -> DataFrame:
    """Merge a batch into the table at ``path``: newest row per key wins. Only the
    partitions the batch touches are read and replaced, so a batch can be replayed
    without harm. Returns the rows of the touched partitions."""
    rest = [c for c in batch.columns if c not in key]

    def newest(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")
    incoming = newest(batch)
    stored = stored_table(batch.sparkSession, path)
    if stored is not None:
        touched = batch.select(partition).distinct()
        incoming = newest(incoming.unionByName(stored.join(touched, partition, "left_semi").select(*incoming.columns)))
    merged = _set_down(incoming, "merged")  # before the folders it came from are replaced
    merged.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return merged


def keep_last_stream(readings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """(series_id, ds, row_no, y): re-sent readings replace earlier ones per (series, day).
    The table is partitioned by month."""
    def on_batch(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("month", F.date_format("ds", "yyyy-MM"))
        merge_latest(rows, path, ("series_id", "ds"), ("row_no", "y"), "month")
    return _run(readings, on_batch, checkpoint)


def realized_stream(
    actuals: DataFrame, forecasts: DataFrame, actuals_path: str, scores_path: str, checkpoint: str,
    key: Sequence[str] = ("series_id",), buckets: int = 64,
) -> StreamingQuery:
    """Actuals (key, ds, row_no, y) arrive; the scores of every series they touch are
    brought up to date. Series are spread over ``buckets`` folders by a hash, and a
    batch reads only the buckets it touches. The forecasts are worked out once, when the stream starts."""
    forecasts = _set_down(forecasts, "forecasts")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        rows = merge_latest(batch.withColumn("bucket", bucket), actuals_path, (*key, "ds"), ("row_no", "y"), "bucket")
        seen = batch.select(*key).distinct()
        known = rows.join(seen, list(key), "left_semi").select(*key, "ds", "y")
        scored = compare(forecasts.join(seen, list(key), "left_semi"), known, key).drop("points")
        merge_latest(scored.withColumn("batch_id", F.lit(batch_id)).withColumn("bucket", bucket), scores_path, key, ("batch_id",), "bucket")
    return _run(actuals, on_batch, checkpoint)


def _run(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_keep_last(readings: DataFrame) -> DataFrame:
    """The batch form the stream must equal."""
    return keep_last(readings).select("series_id", "ds", "y")
