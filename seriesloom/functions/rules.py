"""The numeric rules every operator shares, as Python values and Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# These must equal the published rules for the results to match.
MIN_SERIES_POINTS = 30
MIN_HOLDOUT = 7
HOLDOUT_SHARE = 0.20
MIN_HORIZON_CAP = 14
HORIZON_SHARE = 0.30
MIN_OVERLAP = 7
SPARSE_ZERO_RATIO = 0.70
SPARSE_MEAN = 5
LOW_VOLUME_MEAN = 10
RARE_ZERO_RATIO = 0.80
UNSTABLE_CV = 1.5
OVERLAP_SHARE = 0.3
MIN_SPLIT_POINTS = 15
MIN_MODEL_POINTS = 90
ADI_THRESHOLD = 1.32
CV2_THRESHOLD = 0.49
WEEKEND_ZERO_SHARE = 0.60
FFILL_AUTOCORR = 0.8
YEARLY_HISTORY_DAYS = 365
RECENT_HISTORY_DAYS = 90
INTERMITTENT_ZERO_SHARE = 0.3
CLIP_SKEW = 2.0
IQR_MULTIPLIER = 3.0
DATE_GAP_WARN_SHARE = 0.10
SHORT_HISTORY_DAYS = 90


def _whole(share: float, n: Column) -> Column:
    return F.floor(F.lit(share) * n.cast("double")).cast("int")


def holdout_size(n: Column, test_window: int) -> Column:
    return F.greatest(F.lit(MIN_HOLDOUT), F.least(F.lit(int(test_window)), _whole(HOLDOUT_SHARE, n)))


def effective_horizon(n: Column, horizon: int) -> Column:
    return F.least(F.lit(int(horizon)), F.greatest(F.lit(MIN_HORIZON_CAP), _whole(HORIZON_SHARE, n)))


def min_test_overlap(split: Column) -> Column:
    return F.greatest(F.lit(MIN_OVERLAP), _whole(OVERLAP_SHARE, split))


def sma_window(n: Column) -> Column:
    """Moving-average length: a quarter of the history, kept within 7..28 points."""
    return F.greatest(F.lit(7), F.least(F.lit(28), F.floor(n / 4).cast("int")))


def finite(value: Column) -> Column:
    """NaN and infinities mean "no score"; zero is a real one."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), None).otherwise(number)


def adjusted_skew(value: Column) -> Column:
    """Bias-adjusted sample skewness, null below three values or without spread."""
    n = F.count(value).cast("double")
    spread = F.stddev_pop(value)
    return F.when(
        (n >= 3) & (spread > 0), F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    )
