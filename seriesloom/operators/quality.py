"""Data-quality report: what a forecast run would do to each series, before it runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import rules
from seriesloom.functions.spread import exact_percentiles, join_facts, previous_reading
from seriesloom.functions.timecols import micros, micros_of_day
from seriesloom.operators.prepare import KEY, frequency_of
from seriesloom.operators.typing import type_readings
from seriesloom.session import materialize

BLOCKING, WARNING = "blocking", "warning"


def _plural(n: Column, word: str) -> Column:
    return F.concat(F.format_number(n, 0), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def _percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def _issue(when: Column, code: str, message: Column, severity: str = WARNING) -> Column:
    return F.when(when, F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")
    ))


def _gap() -> Column:
    return (micros(F.col("ds")) - micros(F.col("prev_ds"))) / F.lit(86_400_000_000.0)


def _upper(q1: Column, q3: Column) -> Column:
    return F.when(q3 > q1, q3 + F.lit(rules.IQR_MULTIPLIER) * (q3 - q1))


def _shape() -> list[Column]:
    return [
        F.count("*").alias("n"), F.count("y").alias("usable_points"),
        F.min("ds").alias("start"), F.max("ds").alias("end"),
        F.count_if(F.col("y") < 0).alias("negative_values"), F.count_if(F.col("y") == 0).alias("zero_values"),
        rules.adjusted_skew(F.col("y")).alias("skew"),
    ]


def _gap_shape() -> list[Column]:
    month_start = (F.dayofmonth("ds") == 1) & (F.dayofmonth("prev_ds") == 1)
    return [
        F.count("prev_ds").alias("n_gaps"), F.min(_gap()).alias("min_gap"), F.max(_gap()).alias("max_gap"),
        F.min(F.when(F.col("prev_ds").isNotNull(), month_start)).alias("month_starts"),
    ]


def _measure(series: DataFrame, test_window: int) -> DataFrame:
    """Everything about a series that needs its values, without sorting a series in one task."""
    key = list(KEY)
    shape = series.groupBy(*key).agg(*_shape())
    stepped = previous_reading(series, key, "ds", ["ds"]).where(F.col("prev_ds").isNotNull())
    gaps = stepped.groupBy(*key).agg(*_gap_shape())
    middle = exact_percentiles(stepped.withColumn("_gap", _gap()), key, "_gap", {"median_gap": 0.5})
    quarters = exact_percentiles(series, key, "y", {"q1": 0.25, "q3": 0.75}).select(
        *key, _upper(F.col("q1"), F.col("q3")).alias("upper"))
    facts = shape.select(*key, "n", "start").join(quarters, key, "left")
    on_grid = micros_of_day(F.col("ds")) == micros_of_day(F.col("start"))
    counted = join_facts(series, facts, key, ["ds"]).groupBy(*key).agg(
        F.max("upper").alias("upper"), F.count_if(F.col("y") > F.col("upper")).alias("outliers"),
        F.count(F.when(on_grid, F.col("y"))).alias("kept_on_grid"),
    )
    # the newest rows by a bounded rank, which Spark applies before the shuffle
    most = max(rules.MIN_HOLDOUT, int(test_window))
    newest = series.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ds")))
    ).where(F.col("_rank") <= F.lit(most)).join(shape.select(*key, "n"), key)
    scoreable = newest.where(F.col("_rank") <= rules.holdout_size(F.col("n"), test_window)).groupBy(*key).agg(
        F.count_if(F.col("y") != 0).alias("scoreable"))
    return shape.join(gaps, key, "left").join(middle, key, "left").join(counted, key).join(scoreable, key)


def series_profile(readings: DataFrame, horizon: int, test_window: int) -> DataFrame:
    """One profile row per series from raw text readings (series_id, row_no, ds_raw, y_raw).

    Copies of a timestamp are merged before the shuffle, whose result is written once
    to the checkpoint folder. No task sorts a whole series, however dense it is.
    """
    key = list(KEY)
    typed = type_readings(readings)
    bad_value = F.col("ds").isNotNull() & F.col("y_raw").isNotNull() & F.col("y").isNull()
    base = materialize(typed.groupBy(*key, "ds").agg(
        F.max_by(F.struct("y"), F.struct("row_no", "y")).alias("_l"), F.count("*").alias("_copies"),
        F.count_if(bad_value).alias("_bad"),
    ).select(*key, "ds", F.col("_l.y").alias("y"), "_copies", "_bad"))
    dated = F.col("ds").isNotNull()
    counts = base.groupBy(*key).agg(
        F.sum("_copies").alias("rows_total"), F.sum("_bad").alias("non_numeric_values"),
        F.coalesce(F.sum(F.when(~dated, F.col("_copies"))), F.lit(0)).alias("unparseable_dates"),
        F.coalesce(F.sum(F.when(dated, F.col("_copies") - 1)), F.lit(0)).alias("duplicate_timestamps"),
    )
    series = base.where(dated).select(*key, "ds", "y")
    measured = _measure(series, test_window)
    joined = counts.join(measured, key, "left")
    span = F.floor((micros(F.col("end")) - micros(F.col("start"))) / 86_400_000_000).cast("int")
    ready = F.coalesce(F.col("usable_points"), F.lit(0)) >= rules.MIN_SERIES_POINTS

    def if_ready(col: Column) -> Column:
        return F.when(ready, col)

    def count_or_zero(name: str, col: Column | None = None) -> Column:
        return F.coalesce(F.col(name) if col is None else col, F.lit(0)).cast("bigint").alias(name)

    return joined.withColumn("span_days", span).select(
        *KEY, "rows_total", count_or_zero("usable_points"), "start", "end", "span_days",
        if_ready(frequency_of()).alias("inferred_frequency"), if_ready(F.col("median_gap")).alias("median_gap"),
        if_ready(1 - F.col("kept_on_grid") / (F.col("span_days") + 1)).alias("imputed_share"),
        if_ready(F.col("kept_on_grid")).alias("kept_on_grid"),
        "duplicate_timestamps", "unparseable_dates", "non_numeric_values",
        count_or_zero("negative_values", if_ready(F.col("negative_values"))),
        F.coalesce(if_ready(F.round(F.col("zero_values") / F.col("usable_points"), 4)), F.lit(0.0)).alias("zero_pct"),
        count_or_zero("outliers", if_ready(F.col("outliers"))),
        if_ready(F.col("upper")).alias("upper"), if_ready(F.col("skew")).alias("skew"),
        if_ready(F.col("scoreable")).alias("scoreable"),
        F.coalesce(if_ready(rules.holdout_size(F.col("n"), test_window)), F.lit(0)).alias("test_split_size"),
        F.coalesce(if_ready(rules.effective_horizon(F.col("n"), horizon)), F.lit(0)).alias("effective_horizon"),
        ready.alias("ready"),
    )


def series_issues(profile: DataFrame, horizon: int) -> DataFrame:
    """Add ``issues``: array of (code, severity, message), in report order. Where the profile has a ``metric``, the
    message on values that are no numbers names it."""
    c = F.col
    inside = F.concat(F.lit(" in '"), c("metric"), F.lit("'")) if "metric" in profile.columns else F.lit("")
    ready = c("ready")
    gap = c("median_gap")
    dropped = c("usable_points") - c("kept_on_grid")
    upper = F.format_number(c("upper"), 2)
    will_clip = F.coalesce(F.abs(c("skew")) > rules.CLIP_SKEW, F.lit(False))
    required = rules.min_test_overlap(c("test_split_size"))
    # Report codes and message texts.
    issues = [
        _issue(c("unparseable_dates") > 0, "unparseable_dates", F.concat(
            _plural(c("unparseable_dates"), "row"), F.lit(" with a missing or unreadable date will be dropped."))),
        _issue(c("non_numeric_values") > 0, "non_numeric_values", F.concat(
            _plural(c("non_numeric_values"), "value"), inside, F.lit(" aren't numbers and will be treated as missing."))),
        _issue(c("duplicate_timestamps") > 0, "duplicate_timestamps", F.concat(
            _plural(c("duplicate_timestamps"), "duplicate date"),
            F.lit(": only the last value for each date is kept — values are not summed."))),
        _issue(~ready, "insufficient_history", F.concat(
            F.lit("Only "), _plural(c("usable_points"), "usable data point"),
            F.lit(f"; at least {rules.MIN_SERIES_POINTS} are needed to train and test a model.")), BLOCKING),
        _issue(ready & (gap > 1), "non_daily_frequency", F.concat(
            F.lit("Data is spaced about every "), F.floor(gap).cast("string"),
            F.lit(" days, but the pipeline works on daily data — "), _percent(c("imputed_share")),
            F.lit(" of the daily points it trains on will be filled in, not observed."))),
        _issue(ready & (gap < 1), "non_daily_frequency", F.concat(
            F.lit("Data is recorded more often than daily, but the pipeline keeps one reading per day — "),
            _plural(dropped, "data point"), F.lit(" of "), F.format_number(c("usable_points"), 0),
            F.lit(" will be ignored."))),
        _issue(ready & (gap == 1) & (c("imputed_share") > rules.DATE_GAP_WARN_SHARE), "date_gaps", F.concat(
            _percent(c("imputed_share")), F.lit(" of the days between "), c("start").cast("date").cast("string"),
            F.lit(" and "), c("end").cast("date").cast("string"),
            F.lit(" have no value and will be filled in by the pipeline."))),
        _issue(c("negative_values") > 0, "negative_values", F.concat(
            _plural(c("negative_values"), "negative value"), F.lit(" will be clipped to 0."))),
        _issue(c("outliers") > 0, "outliers", F.concat(
            _plural(c("outliers"), "unusually high value"), F.lit(" (above "), upper, F.lit("); "),
            F.when(will_clip, F.concat(F.lit("they will be clipped to "), upper))
            .otherwise(F.lit("they will be left as-is, and may pull the forecast")), F.lit("."))),
        _issue(ready & (F.lit(int(horizon)) > c("effective_horizon")), "horizon_capped", F.concat(
            F.lit(f"The {int(horizon)}-day horizon will be shortened to "), c("effective_horizon").cast("string"),
            F.lit(" days — the pipeline caps it at 30% of the available history."))),
        _issue(ready & (c("scoreable") < required), "sparse_test_window", F.concat(
            F.lit("Only "), _plural(c("scoreable"), "non-zero value"), F.lit(" in the last "),
            c("test_split_size").cast("string"), F.lit(" points used for testing; models need "),
            required.cast("string"),
            F.lit(" to be scored, so most will be skipped and the run may fall back to a simple moving average."))),
        _issue(ready & (c("span_days") <= rules.SHORT_HISTORY_DAYS), "short_history", F.concat(
            F.lit("Only "), c("span_days").cast("string"),
            F.lit(" days of history — too short for seasonal patterns, so the forecast will mostly follow recent levels."))),
    ]
    return profile.withColumn("issues", F.array_compact(F.array(*issues)))


def quality_report(readings: DataFrame, horizon: int, test_window: int) -> DataFrame:
    """Profile and issues of every series, one row each."""
    return series_issues(series_profile(readings, horizon, test_window), horizon)


def issue_rows(report: DataFrame) -> DataFrame:
    return report.select(*KEY, F.posexplode("issues").alias("issue_no", "issue")).select(
        *KEY, "issue_no", "issue.*"
    )


def is_blocked(issues: Column) -> Column:
    return F.exists(issues, lambda i: i["severity"] == BLOCKING)


def report_gate(report: DataFrame, general: DataFrame) -> DataFrame:
    """One row: may the run start? ``general`` holds issues about the selection
    itself (code, severity, message)."""
    series = report.select(F.lit(True).alias("_series"), is_blocked(F.col("issues")).alias("_blocked"))
    overall = general.select(F.lit(False).alias("_series"), (F.col("severity") == BLOCKING).alias("_blocked"))
    blocked = F.coalesce(F.bool_or("_blocked"), F.lit(False)) | (F.count_if("_series") == 0)
    return series.unionByName(overall).agg(
        F.count_if("_series").alias("n_series"), F.count_if(~F.col("_series")).alias("n_general"),
        blocked.alias("has_blocking"),
    )


def group_issues(report: DataFrame, general: DataFrame) -> DataFrame:
    """Issue counts by severity: issues about the selection first (no label), then
    one group per series."""
    rows = issue_rows(report).select(F.col("series_id").alias("label"), "severity", F.lit(1).alias("place"))
    top = general.select(F.lit(None).cast("string").alias("label"), "severity", F.lit(0).alias("place"))
    return rows.unionByName(top).groupBy("severity", "place", "label").agg(F.count("*").alias("issues"))
