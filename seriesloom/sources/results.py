"""Results, run history and exports: writing, reading back, normalising."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.operators.edits import KEY, replay_steps
from seriesloom.session import materialize, stored_table


BUCKETS = 256


def job_bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")


def write_results(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store rows of runs so that a re-run replaces its own rows and nobody else's.

    Runs are spread over a fixed number of folders by a hash of the job id, since a
    folder per run would not survive millions of runs. Only folders that receive rows
    are rewritten. The rebalance hint lets AQE split a very large folder into files.
    """
    fresh = rows.withColumn("bucket", job_bucket(buckets))
    kept = stored_table(rows.sparkSession, path)
    if kept is not None:
        touched = fresh.select("bucket").distinct()
        others = kept.join(touched, "bucket", "left_semi").join(fresh.select("job_id").distinct(), "job_id", "left_anti")
        fresh = materialize(fresh.unionByName(others))
    fresh.hint("rebalance", "bucket").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_results(spark: SparkSession, path: str, job_id: int | str, buckets: int = BUCKETS) -> DataFrame:
    """One run's rows; the bucket prunes the scan to one folder."""
    bucket = F.pmod(F.xxhash64(F.lit(job_id).cast(spark.read.parquet(path).schema["job_id"].dataType)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("bucket") == bucket) & (F.col("job_id") == job_id)).drop("bucket")


def normalize_results(texts: DataFrame) -> DataFrame:
    """(job_id, result) JSON trees to (job_id, sheet_name, metric_name, body).

    A sheet holds its metrics under "metrics" or directly; entries that are not
    objects are skipped.
    """
    tree = "MAP<STRING, STRING>"

    def is_object(text: Column) -> Column:
        return F.coalesce(F.ltrim(text).startswith("{"), F.lit(False))
    sheets = texts.select("job_id", F.explode(F.from_json("result", tree)).alias("sheet_name", "_sheet"))
    opened = sheets.where(is_object(F.col("_sheet"))).withColumn("_m", F.from_json("_sheet", tree))
    metrics = F.when(F.map_contains_key("_m", "metrics"), F.from_json(F.col("_m")["metrics"], tree)).otherwise(F.col("_m"))
    rows = opened.select("job_id", "sheet_name", F.explode(metrics).alias("metric_name", "body"))
    return rows.where(is_object(F.col("body")))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append run-history rows."""
    rows.write.mode("append").parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of both tables, the newest per key. Combines before the shuffle."""
    rest = [c for c in existing.columns if c not in key]
    return existing.unionByName(incoming).groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def experiment_log(scores: DataFrame) -> DataFrame:
    """Log lines as text columns: five decimals, two for accuracy, blank when unknown."""
    def number(name: str, digits: int) -> Column:
        return F.coalesce(F.format_string(f"%.{digits}f", F.col(name)), F.lit(""))

    def blank_or(name: str, digits: int) -> Column:
        return F.when(F.col(name).isNull(), "").otherwise(number(name, digits))
    # Column names of the log.
    return scores.select(
        F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("sheet_name").alias("Sheet"),
        F.col("metric_name").alias("Metric"), F.col("stage").alias("Stage"), F.col("model_name").alias("Model"),
        *[blank_or(n, 5).alias(n.upper()) for n in ("wmape", "mae", "mape", "rmse")], blank_or("accuracy", 2).alias("Accuracy"))


def write_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").option("header", "true").option("emptyValue", "").csv(path)


def export_frame(records: DataFrame, edits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Export rows: date, actuals, test prediction, then ``forecast`` or, when there
    are edits, ``baseline_forecast`` and one column per edit with the value right
    after it. The edit columns are named from the stack, which is short."""
    base = [*key, F.col("ds").alias("date"), F.col("train_actual").alias("actual_train"),
            F.col("test_actual").alias("actual_test"), "test_prediction"]
    steps = [r[0] for r in edits.select(F.format_string("op_%d_%s", "sequence_no", "operation_type").alias("c"))
             .distinct().orderBy("c").collect()]
    if not steps:
        return records.select(*base, "forecast")
    after = replay_steps(records, edits, key).withColumn("_c", F.format_string("op_%d_%s", "sequence_no", "operation_type"))
    wide = after.groupBy(*key, F.col("ds").alias("date")).pivot("_c", steps).agg(F.max("forecast_after"))
    return records.select(*base, F.col("forecast").alias("baseline_forecast")).join(wide, [*key, "date"], "left")


def write_export(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", "true").csv(path)
