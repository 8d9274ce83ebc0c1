"""Features of daily series. All windows are keyed by series and share one shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import rules
from seriesloom.functions.timecols import is_month_end, is_month_start, is_weekend
from seriesloom.operators.holidays import with_holidays

KEY = ("series_id",)
# Lag distances of the univariate models.
LAGS = (1, 2, 3, 7, 14, 21, 28)
MAX_AUTO_LAG = 40


def _days() -> Window:
    return Window.partitionBy(*KEY).orderBy("ds")


def _so_far(name: str, start: float = 0.0) -> Column:
    """Forward fill, then a start value."""
    w = _days().rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit(start))


def fixed_lags(series: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    return series.select("*", *[F.lag("y", k).over(_days()).alias(f"lag_{k}") for k in lags])


def rolling_stats(series: DataFrame) -> DataFrame:
    """Rolling statistics of the previous days; short histories give values early."""
    def past(k: int):
        return _days().rowsBetween(-k, -1)
    staged = series.select(
        "*", F.avg("y").over(past(7)).alias("roll_mean_7"), F.stddev_samp("y").over(past(7)).alias("_std"),
        F.avg("y").over(past(14)).alias("roll_mean_14"), F.avg("y").over(past(28)).alias("roll_mean_28"),
        F.max("y").over(past(7)).alias("roll_max_7"),
    )
    return staged.withColumn("roll_std_7", _so_far("_std")).drop("_std")


def _full(stat: Column, k: int) -> Column:
    w = _days().rowsBetween(-k, -1)
    return F.when(F.count("y").over(w) == k, stat.over(w))


def strict_rolling_stats(series: DataFrame) -> DataFrame:
    """Rolling statistics that stay null until the window is full."""
    staged = series.select(
        "*", _full(F.max("y"), 3).alias("_max3"), _full(F.stddev_samp("y"), 7).alias("_std7"),
        _full(F.stddev_samp("y"), 28).alias("_std28"),
        *[_full(F.max("y"), k).alias(f"roll_max_{k}") for k in (7, 14, 28)],
        *[_full(F.avg("y"), k).alias(f"roll_mean_{k}") for k in (7, 28)],
    )
    return staged.select(
        "*", _so_far("_max3").alias("roll_max_3"), _so_far("_std7").alias("roll_std_7"),
        _so_far("_std28", 1e-6).alias("roll_std_28"),
    ).drop("_max3", "_std7", "_std28")


def calendar(series: DataFrame) -> DataFrame:
    d = F.col("ds")
    return series.select(
        "*", F.weekday(d).alias("dow"), F.month(d).alias("month"), F.dayofmonth(d).alias("dom"),
        F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("week"), F.quarter(d).alias("quarter"),
        is_month_end(d).alias("is_month_end"), is_month_start(d).alias("is_month_start"),
        is_weekend(d).alias("is_weekend"), (F.weekday(d) == 0).cast("int").alias("is_monday"),
    )


def cyclical(with_calendar: DataFrame) -> DataFrame:
    """Sine and cosine of month, weekday, quarter and week."""
    out = []
    for name, size in (("month", 12), ("dow", 7), ("quarter", 4), ("week", 52)):
        angle = F.lit(2 * math.pi) * F.col(name) / size
        out += [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]
    return with_calendar.select("*", *out)


def univariate_features(series: DataFrame) -> DataFrame:
    """Lags, rolling statistics, calendar and cycles; gaps carried forward, then 0."""
    made = cyclical(calendar(rolling_stats(fixed_lags(series))))
    filled = [f"lag_{k}" for k in LAGS] + ["roll_mean_7", "roll_mean_14", "roll_mean_28", "roll_max_7"]
    keep = [c for c in made.columns if c not in filled]
    return made.select(*keep, *[_so_far(c).alias(c) for c in filled])


def autocorrelations(series: DataFrame, max_lag: int = MAX_AUTO_LAG) -> DataFrame:
    """(series_id, n, lag, acf): biased autocorrelation up to min(max_lag, n/2 − 1).

    All lags come from one window and one aggregate, instead of a self join.
    """
    whole = Window.partitionBy(*KEY)
    centred = series.where(F.col("y").isNotNull()).withColumn("_c", F.col("y") - F.avg("y").over(whole))
    lagged = centred.select(*KEY, "_c", *[F.lag("_c", k).over(_days()).alias(f"_l{k}") for k in range(1, max_lag + 1)])
    sums = lagged.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.sum(F.col("_c") * F.col("_c")).alias("_var"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)],
    )
    cells = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("_s")) for k in range(1, max_lag + 1)])
    return sums.select(*KEY, "n", "_var", F.explode(cells).alias("_x")).where(
        F.col("_x.lag") <= F.floor(F.col("n") / 2) - 1
    ).select(*KEY, "n", F.col("_x.lag").alias("lag"), F.try_divide(F.col("_x._s"), F.col("_var")).alias("acf"))


def significant_lags(acf: DataFrame) -> DataFrame:
    """(series_id, lags): lags beyond 1.96/√n, lag 1 always among them, first ten.
    A series too short for any lag is left out; use lags 1 and 7 for it."""
    strong = F.abs(F.col("acf")) > 1.96 / F.sqrt(F.col("n"))
    found = acf.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.when(strong | (F.col("lag") == 1), F.col("lag")))).alias("lags"))
    return found.select(*KEY, F.slice("lags", 1, 10).alias("lags"))


def dynamic_lags(series: DataFrame, lags: DataFrame, max_lag: int = MAX_AUTO_LAG) -> DataFrame:
    """Add ``lag_values``: MAP of each significant lag to y that many days before."""
    w = _days()
    history = series.withColumn("_past", F.array(*[F.lag("y", k).over(w) for k in range(1, max_lag + 1)]))
    joined = history.join(lags, list(KEY), "left")
    use = F.coalesce(F.col("lags"), F.array(F.lit(1), F.lit(7)))
    values = F.transform(use, lambda k: F.get(F.col("_past"), k - 1))
    return joined.withColumn("lag_values", F.map_from_arrays(use, values)).drop("_past", "lags")


def smart_momentum(series: DataFrame) -> DataFrame:
    """Monday looks at Friday, every other day at the day before."""
    w = _days()
    return series.withColumn("smart_momentum", F.when(F.weekday("ds") == 0, F.lag("y", 3).over(w)).otherwise(F.lag("y", 1).over(w)))


def ratios(with_stats: DataFrame, trend_lag: int = 7) -> DataFrame:
    """Trend, volatility and spike ratios from strict rolling statistics."""
    w = _days()
    small = F.lit(1e-6)
    return with_stats.select(
        "*",
        (F.lag("y", trend_lag).over(w) / (F.col("roll_mean_7") + small)).alias("trend_strength"),
        (F.col("roll_std_7") / (F.col("roll_std_28") + small)).alias("volatility_ratio"),
        (F.lag("y", 1).over(w) / (F.col("roll_max_28") + small)).alias("spike_ratio"),
    )


def multivariate_features(
    series: DataFrame, regions: Sequence[str] = ("US", "IN"), lags: Sequence[int] = (1, 7),
    covariates: DataFrame | None = None, holidays_extra: DataFrame | None = None,
) -> DataFrame:
    """The full feature frame: calendar, cycles, holidays, lags, strict rolling
    statistics, ratios and covariates; rows without a full history are dropped."""
    positive = series.withColumn("y", F.greatest("y", F.lit(0.0)))
    trend_lag = 7 if 7 in lags else 1
    made = ratios(smart_momentum(strict_rolling_stats(fixed_lags(positive, lags))), trend_lag)
    made = with_holidays(cyclical(calendar(made)), regions, holidays_extra)
    if covariates is not None:
        names = [c for c in covariates.columns if c not in ("series_id", "ds")]
        made = made.join(covariates, ["series_id", "ds"], "left")
        made = made.select(*[c for c in made.columns if c not in names], *[_so_far(c).alias(c) for c in names])
    return made.dropna()


def log_switch(series: DataFrame) -> DataFrame:
    """Per series: does the target need a log scale?"""
    facts = series.withColumn("y", F.greatest("y", F.lit(0.0))).groupBy(*KEY).agg(
        rules.adjusted_skew(F.col("y")).alias("skew")
    )
    return facts.withColumn("use_log", F.coalesce(F.abs(F.col("skew")) > 2.0, F.lit(False)))


def to_target(y: Column, use_log: Column) -> Column:
    return F.when(use_log, F.log1p(F.greatest(y, F.lit(0.0)))).otherwise(y)


def from_target(y: Column, use_log: Column) -> Column:
    return F.when(use_log, F.expm1(y)).otherwise(y)


def decompose(series: DataFrame, period: int = 7) -> DataFrame:
    """Additive decomposition: centred moving average, mean per phase, residual.
    ``period`` must be odd."""
    half = period // 2
    around = _days().rowsBetween(-half, half)
    phased = series.withColumn("_n", F.row_number().over(_days())).select(
        "*", F.when(F.count("y").over(around) == period, F.avg("y").over(around)).alias("trend"),
        F.pmod(F.col("_n") - 1, F.lit(period)).alias("phase"),
    ).withColumn("_d", F.col("y") - F.col("trend"))
    by_phase = Window.partitionBy(*KEY, "phase")
    meaned = phased.withColumn("_m", F.avg("_d").over(by_phase)).withColumn("_c", F.count("*").over(by_phase))
    centre = F.sum(F.col("_m") / F.col("_c")).over(Window.partitionBy(*KEY)) / F.lit(period)
    out = meaned.withColumn("seasonal", F.col("_m") - centre)
    return out.withColumn("residual", F.col("y") - F.col("trend") - F.col("seasonal")).drop("_n", "_d", "_m", "_c")
