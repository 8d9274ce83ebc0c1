"""Forecast metrics, all from one grouped aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-8


def wmape(actual: str = "actual", predicted: str = "predicted") -> Column:
    a, p = F.coalesce(actual, F.lit(0.0)), F.coalesce(predicted, F.lit(0.0))
    return F.sum(F.abs(a - p)) / (F.sum(F.abs(a)) + F.lit(EPS))


def mae(actual: str = "actual", predicted: str = "predicted") -> Column:
    return F.when(_complete(actual, predicted), F.avg(F.abs(F.col(actual) - F.col(predicted))))


def mape(actual: str = "actual", predicted: str = "predicted") -> Column:
    a = F.when(F.abs(F.col(actual)) > EPS, F.col(actual))
    return F.avg(F.abs((a - F.col(predicted)) / a)) * 100


def rmse(actual: str = "actual", predicted: str = "predicted") -> Column:
    miss = F.col(actual) - F.col(predicted)
    return F.when(_complete(actual, predicted), F.sqrt(F.avg(miss * miss)))


def _complete(actual: str, predicted: str) -> Column:
    """A null on either side makes MAE and RMSE undefined."""
    return F.count("*") == F.count(F.col(actual) - F.col(predicted))


def accuracy(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - score) * 100))


def with_position(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rank of each finite pair by date: the x axis for the trend term."""
    have = F.col("actual").isNotNull() & F.col("predicted").isNotNull()
    w = Window.partitionBy(*key).orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    place = F.count(F.when(have, 1)).over(w) - 1
    return pairs.withColumn("_x", F.when(have, place.cast("double")))


def _trend_error() -> Column:
    a = F.when(F.col("_x").isNotNull(), F.col("actual"))
    p = F.when(F.col("_x").isNotNull(), F.col("predicted"))
    gap = F.abs(F.regr_slope(a, F.col("_x")) - F.regr_slope(p, F.col("_x")))
    return F.when(F.count("_x") < 2, 0.0).otherwise(gap / (F.avg(F.abs(a)) + F.lit(EPS)))


def trend_error(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    return with_position(pairs, key).groupBy(*key).agg(_trend_error().alias("trend_error"))


def variance_penalty(train_std: Column, forecast_std: Column, tolerance: float = 2.5) -> Column:
    ratio = forecast_std / (train_std + F.lit(EPS))
    excess = ratio - tolerance
    return (
        F.when(forecast_std.isNull() | F.isnan(forecast_std), 0.0)
        .when(ratio <= tolerance, 0.0)
        .otherwise(F.least(F.lit(1.0), excess / (excess + 1.0)))
    )


# Weights of the composite score.
W_WMAPE, W_TREND, W_VARIANCE = 0.70, 0.20, 0.10


def composite(score: Column, trend: Column, variance: Column) -> Column:
    def known(term: Column) -> Column:
        return F.coalesce(F.nanvl(term, F.lit(None).cast("double")), F.lit(0.0))
    return W_WMAPE * score + W_TREND * known(trend) + W_VARIANCE * known(variance)


def coverage(intervals: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of actuals within [lower, upper]."""
    inside = F.col("actual").between(F.col("lower"), F.col("upper"))
    return intervals.groupBy(*key).agg(
        F.coalesce(F.avg(F.coalesce(inside, F.lit(False)).cast("double")), F.lit(0.0)).alias("coverage")
    )


def backtest_bias(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """(Σactual − Σpredicted) / Σactual: positive means the forecast was too low."""
    a = F.sum("actual")
    return pairs.groupBy(*key).agg(((a - F.sum("predicted")) / (a + F.lit(1e-6))).alias("forecast_bias"))


def score_pairs(pairs: DataFrame, key: Sequence[str], train_std: DataFrame | None = None) -> DataFrame:
    """All metrics per key from (key, ds, actual, predicted).

    With ``train_std`` (series_id, train_std) the composite score is added; the
    prediction itself stands in for the forecast in its variance term.
    """
    base = [
        F.count("*").alias("n"), wmape().alias("wmape"), mae().alias("mae"), mape().alias("mape"),
        rmse().alias("rmse"), accuracy(wmape()).alias("accuracy"),
    ]
    if train_std is None:
        return pairs.groupBy(*key).agg(*base)
    scored = with_position(pairs, key).groupBy(*key).agg(
        *base, _trend_error().alias("trend_error"), F.stddev_samp("predicted").alias("_fc_std")
    )
    penalty = variance_penalty(F.col("train_std"), F.col("_fc_std"))
    return scored.join(train_std, "series_id").withColumn("variance_penalty", penalty).withColumn(
        "composite_score", composite(F.col("wmape"), F.col("trend_error"), F.col("variance_penalty"))
    ).drop("_fc_std", "train_std")
