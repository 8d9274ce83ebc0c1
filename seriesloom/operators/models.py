"""Closed-form forecast models: plain aggregates over all series at once.

Every model is fitted per (series_id, kind). ``kind`` is 'test' for the fit on the
training window, scored on the test window, and 'future' for the refit that gives
the forecast. A model yields parameter rows; ``predict`` spreads them over targets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import rules
from seriesloom.operators.prepare import frequency, future_calendar, gap_facts

FIT = ("series_id", "kind")
CROSTON_ALPHA = 0.1


def targets(series: DataFrame, cutoff: DataFrame, horizon: int, freq: DataFrame | None = None) -> DataFrame:
    """(series_id, kind, step, ds): the raw test dates, then the future calendar."""
    w = Window.partitionBy("series_id").orderBy("ds")
    test = (
        series.join(cutoff.where("status = 'ready'").select("series_id", "test_start"), "series_id")
        .where(F.col("ds") >= F.col("test_start"))
        .select("series_id", F.lit("test").alias("kind"), F.row_number().over(w).alias("step"),
                F.col("ds").cast("date").alias("ds"))
    )
    freq = frequency(gap_facts(series)) if freq is None else freq
    last = series.groupBy("series_id").agg(F.max("ds").alias("last_ds")).join(
        cutoff.where("status = 'ready'").select("series_id", rules.effective_horizon(F.col("n"), horizon).alias("horizon")), "series_id"
    ).join(freq.select("series_id", "freq"), "series_id")
    future = future_calendar(last).select("series_id", F.lit("future").alias("kind"), "step", F.col("ds").cast("date").alias("ds"))
    return test.unionByName(future)


def fit_rows(views: DataFrame) -> DataFrame:
    """Cleaned views to fitting rows: train rows serve both fits, test rows the refit."""
    kinds = F.when(F.col("part") == "train", F.array(F.lit("test"), F.lit("future"))).otherwise(F.array(F.lit("future")))
    return views.where(F.col("part").isin("train", "test")).select("series_id", F.explode(kinds).alias("kind"), "ds", "y")


def baseline_rows(views: DataFrame) -> DataFrame:
    """Fitting rows of the moving average: train for the test, the full view for the future."""
    kind = F.when(F.col("part") == "train", "test").when(F.col("part") == "full", "future")
    return views.select("series_id", kind.alias("kind"), "ds", "y").where("kind is not null")


def fit_sma(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy(*FIT).agg(F.count("*").alias("n"))
    newest = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*FIT).orderBy(F.desc("ds")))).where(
        F.col("_rank") <= 28
    )
    return newest.join(counts, list(FIT)).where(F.col("_rank") <= rules.sma_window(F.col("n"))).groupBy(*FIT).agg(
        F.avg("y").alias("level")
    )


def numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t", F.row_number().over(Window.partitionBy(*FIT).orderBy("ds")).cast("double"))


def series_arrays(rows: DataFrame) -> DataFrame:
    """(series_id, kind, ys): the values of each fit in date order."""
    ordered = F.array_sort(F.collect_list(F.struct("ds", "y")))
    return rows.groupBy(*FIT).agg(F.transform(ordered, lambda s: s["y"]).alias("ys"))


def fit_linear(rows: DataFrame) -> DataFrame:
    """OLS line over t = 1..n; ``n`` goes along so a target step s sits at n + s."""
    return numbered(rows).groupBy(*FIT).agg(
        F.count("*").alias("n"), F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("intercept")
    )


def _croston_sums(ys: pa.Array, alpha: float) -> pa.Array:
    """Per fit the smoothed size and interval; null without a sale, and the interval null without a second one."""
    offsets = np.concatenate([[0], np.cumsum(ys.value_lengths().to_numpy())]).astype(np.int64)
    values = ys.flatten()
    y = values.fill_null(0.0).to_numpy().astype(float)
    at = np.flatnonzero((y > 0) | np.isnan(y))  # nan is the greatest number, as in SQL
    fits = len(offsets) - 1
    fit = np.searchsorted(offsets, at, side="right") - 1
    m = np.bincount(fit, minlength=fits)
    first = np.cumsum(m) - m
    j = np.arange(len(at)) - first[fit]
    fade = (1 - alpha) ** (m[fit] - 1 - j)
    gap = np.diff(at, prepend=0).astype(float)
    size = np.bincount(fit, y[at] * np.where(j == 0, fade, alpha * fade), minlength=fits)
    mean = np.bincount(fit, np.where(j > 0, gap, 0.0), minlength=fits) / np.maximum(m - 1, 1)
    interval = (1 - alpha) ** np.maximum(m - 2, 0) * mean + np.bincount(fit, np.where(j > 1, alpha * fade * gap, 0.0), minlength=fits)
    return pa.StructArray.from_arrays([pa.array(size, mask=m == 0), pa.array(interval, mask=m < 2)], ["size", "interval"])


def fit_croston(rows: DataFrame, alpha: float = CROSTON_ALPHA) -> DataFrame:
    """Smoothed size over smoothed interval. Exponential smoothing with a fixed alpha is a weighted sum, so a fit is one row
    of its values, and many fits are summed at once."""
    @F.arrow_udf("struct<size: double, interval: double>")
    def sums(ys: pa.Array) -> pa.Array:
        return _croston_sums(ys, alpha)
    fitted = series_arrays(rows).select(*FIT, sums("ys").alias("_s"))
    interval = F.greatest(F.coalesce("_s.interval", F.lit(1.0)), F.lit(1.0))
    return fitted.select(*FIT, F.coalesce(F.greatest(F.lit(0.0), F.col("_s.size") / interval), F.lit(0.0)).alias("level"))


def predict(fitted: DataFrame, wanted: DataFrame, model: str, value: Column) -> DataFrame:
    """Parameter rows × target dates to (series_id, model, kind, step, ds, yhat), never negative."""
    return wanted.join(fitted, list(FIT)).select(
        "series_id", F.lit(model).alias("model"), "kind", "step", "ds", F.greatest(value, F.lit(0.0)).alias("yhat")
    )


def line(step: Column) -> Column:
    return F.col("intercept") + F.col("slope") * (F.col("n") + step)


def predict_sma(views: DataFrame, wanted: DataFrame) -> DataFrame:
    return predict(fit_sma(baseline_rows(views)), wanted, "Baseline_SMA", F.col("level"))


def predict_linear(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return predict(fit_linear(rows), wanted, "LinearBaseline", line(F.col("step")))


def predict_croston(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return predict(fit_croston(rows), wanted, "Croston", F.col("level"))


def align_predictions(predicted: DataFrame, wanted: DataFrame) -> DataFrame:
    """Predictions on exactly the wanted test dates: the last one is carried forward,
    0 stands before the first."""
    asked = wanted.where("kind = 'test'").select("series_id", "ds").join(
        predicted.select("series_id", "model").distinct(), "series_id"
    )
    joined = asked.join(predicted.where("kind = 'test'").select("series_id", "model", "ds", "yhat"), ["series_id", "model", "ds"], "left")
    w = Window.partitionBy("series_id", "model").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("yhat", F.coalesce(F.last("yhat", ignorenulls=True).over(w), F.lit(0.0)))
