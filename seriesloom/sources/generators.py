"""Synthetic daily series for demos and tests, one per key.

Random draws come from a hash of (series, day, draw), so a lost task reproduces
exactly the same values.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# First day and length of every generated series.
START, DAYS = "2023-01-01", 730


def _uniform(draw: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64("series_id", "t", F.lit(draw)), 11)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 53))


def _normal(draw: int) -> Column:
    return F.sqrt(-2.0 * F.log(_uniform(draw))) * F.cos(F.lit(2 * math.pi) * _uniform(draw + 1))


def _gamma(shape: float, scale: float, draw: int) -> Column:
    """Cube-root normal approximation of a gamma draw."""
    root = 1 - 1 / (9 * shape) + _normal(draw) / (3 * math.sqrt(shape))
    return F.lit(shape * scale) * F.pow(F.greatest(root, F.lit(0.0)), F.lit(3.0))


def days_of(keys: DataFrame, days: int = DAYS) -> DataFrame:
    """(series_id, t, ds) for every key."""
    return keys.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("t")).withColumn(
        "ds", F.date_add(F.lit(START).cast("date"), F.col("t")))


def smooth_retail(keys: DataFrame) -> DataFrame:
    """Yearly and weekly swing around 500 with two covariates."""
    turn = F.lit(2 * math.pi)
    base = 500 + 60 * F.sin(turn * F.col("t") / 365.25) + 25 * F.sin(turn * F.col("t") / 7)
    sold = days_of(keys).withColumn("y", F.greatest(F.lit(1.0), F.round(base + 18 * _normal(1))))
    return sold.select(
        "series_id", "ds", "y", F.greatest(F.lit(0.0), F.round(1000 + 0.6 * (F.col("y") - 500) + 25 * _normal(3), 2)).alias("marketing_spend"),
        F.round(18 + 12 * F.sin(turn * (F.col("t") - 100) / 365.25) + 2 * _normal(5), 1).alias("avg_temp_c"))


def intermittent_parts(keys: DataFrame) -> DataFrame:
    """A steady order size on about one day in four."""
    size = F.round(F.greatest(F.lit(1.0), 20 + 3 * _normal(3)))
    return days_of(keys).select("series_id", "ds", F.when(_uniform(1) < 0.25, size).otherwise(0.0).alias("y"))


def lumpy_parts(keys: DataFrame) -> DataFrame:
    """Rare orders of wildly different size."""
    size = F.round(F.greatest(F.lit(1.0), _gamma(1.1, 18.0, 3)))
    return days_of(keys).select("series_id", "ds", F.when(_uniform(1) < 0.22, size).otherwise(0.0).alias("y"))


def trend_season_demo(keys: DataFrame) -> DataFrame:
    """Trend, season, weekend lift, holiday spikes and a competitor's price."""
    doy = F.dayofyear("ds")
    turn = F.lit(2 * math.pi / 365)
    n = 732
    rows = days_of(keys, n).select(
        "series_id", "ds", "t",
        F.round(F.greatest(F.lit(0.0), 1000 + 500 * F.sin(turn * doy) + 100 * _normal(1)), 2).alias("marketing_spend"),
        F.round(20 + 15 * F.sin(turn * (doy - 100)) + 3 * _normal(3), 1).alias("temperature_c"),
        (_uniform(5) < 0.03).cast("int").alias("is_holiday"),
        F.round(50 + 0.2 * F.sqrt(F.col("t") + 1) * _normal(7), 2).alias("competitor_price"))
    sales = (
        500 + 500 * F.col("t") / (n - 1) + 200 * F.sin(turn * doy) + F.when(F.weekday("ds") >= 5, 300).otherwise(0)
        + 0.5 * F.col("marketing_spend") + 500 * F.col("is_holiday") - 10 * F.col("competitor_price") + 50 * _normal(9))
    return rows.withColumn("y", F.round(F.greatest(F.lit(0.0), sales), 2)).drop("t")
