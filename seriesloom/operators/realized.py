"""Realized accuracy: stored forecasts against the values that arrived later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.operators.edits import replay

KEY = ("job_id", "sheet_name", "metric_name")
# Fixed value: how many candidate uploads a job lists.
MAX_CANDIDATES = 20


def pair_sheets(job_sheets: DataFrame, upload_sheets: DataFrame, by: str = "job_id") -> DataFrame:
    """(by, job_sheet, upload_sheet): same names pair; a lone job sheet pairs with a
    lone upload sheet whatever they are called; nothing else is guessed."""
    jobs, ups = job_sheets.distinct(), upload_sheets.distinct()
    named = jobs.join(ups, (jobs[by] == ups[by]) & (jobs["job_sheet"] == ups["upload_sheet"])).select(
        jobs[by], "job_sheet", "upload_sheet"
    )
    one_job = jobs.groupBy(by).agg(F.count("*").alias("_n"), F.first("job_sheet").alias("job_sheet")).where("_n = 1")
    one_up = ups.groupBy(by).agg(F.count("*").alias("_n"), F.first("upload_sheet").alias("upload_sheet")).where("_n = 1")
    alone = one_job.drop("_n").join(one_up.drop("_n"), by).select(by, "job_sheet", "upload_sheet")
    return named.unionByName(alone).distinct()


def by_day(readings: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last value per calendar day; a null last value wins. Combines map-side."""
    day = F.col("ds").cast("date")
    return readings.withColumn("_day", day).groupBy(*key, "_day").agg(
        F.max_by(F.struct("y"), F.struct(*order)).alias("_l")
    ).select(*key, F.col("_day").alias("ds"), F.col("_l.y").alias("y"))


def actual_series(readings: DataFrame, key: Sequence[str], order: Sequence[str] = ("ds", "row_no")) -> DataFrame:
    """Typed readings (key, row_no, ds, y) to one actual per day; not clipped."""
    return by_day(readings.where(F.col("ds").isNotNull()), key, order)


def forecast_series(records: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("ds", "forecast")) -> DataFrame:
    """Non-null forecasts by day; of several on a day the last in ``order`` stays."""
    usable = records.where(F.col("ds").isNotNull() & F.col("forecast").isNotNull())
    return usable.groupBy(*key, F.col("ds").cast("date").alias("_day")).agg(
        F.max_by("forecast", F.struct(*order)).alias("forecast")).withColumnRenamed("_day", "ds").select(*key, "ds", "forecast")


def _scores(a: str, f: str) -> list[Column]:
    size = F.sum(F.abs(F.col(a)))
    miss = F.sum(F.abs(F.col(a) - F.col(f)))
    hit = F.count(F.col(a) - F.col(f))
    known = size > 0
    return [
        hit.alias("matched_points"),
        F.when(known, miss / size).alias("wmape"),
        F.try_divide(miss, hit).alias("mae"),
        F.when(known, (F.sum(f) - F.sum(a)) / size).alias("bias"),
        F.coalesce(F.sum(a), F.lit(0.0)).alias("actual_total"),
        F.coalesce(F.sum(f), F.lit(0.0)).alias("forecast_total"),
    ]


def compare(forecasts: DataFrame, actuals: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per forecast key: scores over the days both sides have, the points,
    and how far the actuals reach.

    A forecast is at most its horizon long, so the points array is bounded.
    """
    k = list(key)
    days = forecasts.join(actuals.where(F.col("y").isNotNull()), [*k, "ds"], "left")
    both = days.withColumn("_a", F.col("y")).withColumn("_f", F.when(F.col("y").isNotNull(), F.col("forecast")))
    point = F.when(F.col("y").isNotNull(), F.struct(
        F.col("ds").alias("date"), F.col("y").alias("actual"), F.col("forecast").alias("forecast")
    ))
    scored = both.groupBy(*k).agg(
        F.count("*").alias("forecast_points"), *_scores("_a", "_f"),
        F.array_sort(F.collect_list(point)).alias("points"),
    )
    return scored.join(actuals_last_date(actuals, key), k, "left").withColumn("status", status_for())


def actuals_last_date(actuals: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return actuals.groupBy(*key).agg(
        F.max(F.when(F.col("y").isNotNull(), F.col("ds"))).alias("actuals_last_date")
    )


def status_for() -> Column:
    m, f = F.col("matched_points"), F.col("forecast_points")
    return F.when(m <= 0, "no_overlap").when(m >= f, "complete").otherwise("partial")


def skip_reasons(job_metrics: DataFrame, pairs: DataFrame, upload_columns: DataFrame) -> DataFrame:
    """Why a job metric is not compared. ``job_metrics`` (job_id, job_sheet, metric),
    ``pairs`` from ``pair_sheets``, ``upload_columns`` (job_id, upload_sheet, metric).
    ``file_rejected`` is true when the upload holds none of the job's metrics."""
    held = upload_columns.select("job_id", "upload_sheet", "metric", F.lit(True).alias("_held")).distinct()
    anywhere = held.select("job_id", "metric", F.lit(True).alias("_any")).distinct()
    rows = (
        job_metrics.join(pairs, ["job_id", "job_sheet"], "left")
        .join(held, ["job_id", "upload_sheet", "metric"], "left")
        .join(anywhere, ["job_id", "metric"], "left")
    )
    present = rows.groupBy("job_id").agg(F.bool_or(F.coalesce("_any", F.lit(False))).alias("_present"))
    reason = F.when(F.col("upload_sheet").isNull(), "sheet_unpaired").when(F.col("_held").isNull(), "metric_missing")
    return rows.join(present, "job_id").select(
        "job_id", "job_sheet", "metric", "upload_sheet", reason.alias("reason"), (~F.col("_present")).alias("file_rejected")
    )


def newest_evaluations(evaluations: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The newest evaluation per key, by created_at then id. Combines map-side."""
    rest = [c for c in evaluations.columns if c not in key]
    return evaluations.groupBy(*key).agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("e")
    ).select(*key, "e.*")


def realized_view(forecasts: DataFrame, evaluations: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every (job, sheet, metric) with a forecast: its newest evaluation, or
    ``awaiting_actuals`` with the period it needs."""
    period = forecasts.groupBy(*key).agg(
        F.count("*").alias("period_points"), F.min("ds").alias("forecast_start"), F.max("ds").alias("forecast_end")
    )
    newest = newest_evaluations(evaluations, key)
    measured = F.col("matched_points") > 0
    return period.join(newest, list(key), "left").select(
        *key, F.col("period_points").alias("forecast_points"), "forecast_start", "forecast_end",
        F.when(F.col("id").isNull(), "awaiting_actuals").otherwise(status_for()).alias("status"),
        F.when(measured, F.col("wmape")).alias("wmape"), F.when(measured, F.col("matched_points")).alias("matched_points"),
    )


def adjusted_scores(records: DataFrame, edits: DataFrame, points: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Score the edited forecast against stored points (key, ds, actual). Only keys
    that have edits get a row."""
    k = list(key)
    edited = replay(records, edits, key).join(edits.select(*k).distinct(), k, "left_semi")
    now = edited.where(F.col("edited_forecast").isNotNull()).select(
        *k, F.col("ds").cast("date").alias("ds"), F.col("edited_forecast").alias("_f")
    )
    return points.join(now, [*k, "ds"]).groupBy(*k).agg(*_scores("actual", "_f"))


def candidate_uploads(jobs: DataFrame, job_metrics: DataFrame, uploads: DataFrame, upload_columns: DataFrame) -> DataFrame:
    """Per job: the owner's newer uploads, other than its input, holding at least one
    of its metric columns; newest 20 with ``place``.

    "Newer than the job" only cuts the tail of a newest-first list, and the input is
    a single upload, so per (owner, column) the newest 21 uploads decide every job.
    They are found by a rank with a fixed bound, which Spark applies before the
    shuffle; a column that many uploads share never meets all jobs that ask for it.
    They stay one list per (owner, column), so a job's lists meet in one row per
    metric and are merged there.
    """
    newest = Window.partitionBy("user_id", "column_name").orderBy(F.desc("uploaded_at"), F.desc("upload_id"))
    offered = upload_columns.select("upload_id", "column_name").distinct().join(
        uploads.select("upload_id", "user_id", F.col("created_at").alias("uploaded_at")), "upload_id"
    ).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= MAX_CANDIDATES + 1)
    asked = job_metrics.select("job_id", F.col("metric").alias("column_name")).distinct().join(
        jobs.select("job_id", "user_id", F.col("created_at").alias("_job_at"), "input_upload_id"), "job_id"
    )
    lists = offered.groupBy("user_id", "column_name").agg(F.collect_list(F.struct("uploaded_at", "upload_id")).alias("_ups"))
    fits = F.filter("_ups", lambda u: (u["uploaded_at"] > F.col("_job_at")) & ~F.coalesce(u["upload_id"] == F.col("input_upload_id"), F.lit(False)))
    hits = asked.join(lists, ["user_id", "column_name"]).select("job_id", fits.alias("_ups")).where(F.size("_ups") > 0)
    newest_first = hits.groupBy("job_id").agg(F.sort_array(F.flatten(F.collect_list("_ups")), False).alias("_all"))
    # equal ones are neighbours now
    once = F.filter("_all", lambda u, i: (i == 0) | (u != F.get("_all", i - 1)))
    return newest_first.select("job_id", F.posexplode(F.slice(once, 1, MAX_CANDIDATES)).alias("_at", "_u")).select(
        "job_id", "_u.upload_id", "_u.uploaded_at", (F.col("_at") + 1).alias("place"))
