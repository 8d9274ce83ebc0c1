"""Series preparation: dedupe, daily grid, treatment, imputation, splitting.

Daily operators work on (series_id, ds DATE, y). A daily series is bounded by the
calendar, so they use windows keyed by series: one shuffle, reused by every window.
Raw readings of any density go through ``keep_last`` and ``on_daily_grid`` first.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import rules
from seriesloom.functions.spread import exact_percentiles, join_facts, previous_reading
from seriesloom.functions.timecols import micros, micros_of_day

KEY = ("series_id",)


def keep_last(readings: DataFrame, order: Sequence[str] = ("row_no",), key: Sequence[str] = KEY) -> DataFrame:
    """One row per (series, timestamp): the last in file order, null or not.

    ``max_by`` combines on the map side, so copies never travel.
    """
    last = F.max_by(F.struct("y"), F.struct(*order, "y"))
    return readings.groupBy(*key, "ds").agg(
        last.alias("_l"), F.count("*").alias("_copies")
    ).select(*key, "ds", F.col("_l.y").alias("y"), (F.col("_copies") - 1).alias("duplicates"))


def enough_points(series: DataFrame, min_points: int = rules.MIN_SERIES_POINTS) -> DataFrame:
    """Per series: usable points and whether it may run, with the reason if not."""
    n = F.col("usable")
    return series.groupBy(*KEY).agg(F.count("y").alias("usable")).select(
        *KEY, "usable",
        F.when(n >= min_points, "ready").otherwise("skipped").alias("status"),
        F.when(n < min_points, F.format_string(
            "SKIP: Only %d non-null points (min required = %d)", n, F.lit(min_points)
        )).alias("reason"),
    )


def with_facts(series: DataFrame, facts: DataFrame, bounded: bool = True) -> DataFrame:
    """Per-series facts on every row of the series.

    For bounded series this is a shuffled hash join: the series moves once, by key,
    and the windows that follow reuse that layout. A broadcast of the small side
    could leave the windows on whatever few partitions the other side had.
    """
    if bounded:
        return series.join(facts.hint("shuffle_hash"), list(KEY))
    return join_facts(series, facts, KEY, ["ds"])


def gate_min_points(series: DataFrame, min_points: int = rules.MIN_SERIES_POINTS, bounded: bool = True) -> DataFrame:
    ready = enough_points(series, min_points).where("status = 'ready'").select(*KEY)
    return with_facts(series, ready, bounded)


def on_daily_grid(series: DataFrame) -> DataFrame:
    """Readings that fall on the daily grid anchored at the first timestamp's time
    of day. Result has ``ds`` as DATE; the shared time of day is in ``anchor_us``."""
    anchors = series.groupBy(*KEY).agg(
        F.min("ds").alias("_start"), F.max("ds").alias("_end")
    ).withColumn("anchor_us", micros_of_day(F.col("_start")))
    hits = join_facts(series, anchors, KEY, ["ds"]).where(
        micros_of_day(F.col("ds")) == F.col("anchor_us")
    ).select(*KEY, F.col("ds").cast("date").alias("ds"), "y", "anchor_us")
    # the grid's last day, even when the reading that sets it is off the grid
    last_day = F.when(
        micros_of_day(F.col("_end")) >= F.col("anchor_us"), F.col("_end").cast("date")
    ).otherwise(F.date_sub(F.col("_end").cast("date"), 1))
    ends = anchors.select(*KEY, last_day.alias("ds"), F.lit(None).cast("double").alias("y"), "anchor_us")
    return hits.unionByName(ends).groupBy(*KEY, "ds").agg(
        F.max("y").alias("y"), F.max("anchor_us").alias("anchor_us")
    )


def daily_grid(series: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Add the missing days between a series' first and last date with null y.

    Each row is stretched up to the day before its successor, so the gap filling
    needs no join and keeps the series partitioning for the windows that follow.
    """
    w = Window.partitionBy(*key).orderBy("ds")
    upto = F.coalesce(F.date_sub(F.lead("ds").over(w), 1), F.col("ds"))
    # day numbers: steps of an interval are worked out on timestamps, many times slower
    stretched = series.withColumn("_days", F.sequence(F.unix_date("ds"), F.unix_date(upto), F.lit(1)))
    rest = [c for c in series.columns if c not in (*key, "ds", "y")]
    return stretched.select(
        *key, *rest, F.col("ds").alias("_seen"), F.explode("_days").alias("_day"), F.col("y").alias("_y")
    ).withColumn("ds", F.date_from_unix_date("_day")).select(
        *key, "ds", F.when(F.col("ds") == F.col("_seen"), F.col("_y")).alias("y"),
        (F.col("ds") == F.col("_seen")).alias("was_observed"), *rest,
    )


def lag1_autocorrelation(series: DataFrame, bounded: bool = True) -> DataFrame:
    """Pearson correlation of y with the previous non-null y, per series.

    ``bounded=False`` is for raw readings that may be very dense: the series is
    then cut into pieces instead of being sorted in one task.
    """
    present = series.where(F.col("y").isNotNull())
    if bounded:
        w = Window.partitionBy(*KEY).orderBy("ds")
        paired = present.withColumn("prev_y", F.lag("y").over(w))
    else:
        paired = previous_reading(present, KEY, "ds", ["y"])
    have = F.col("prev_y").isNotNull()
    both = paired.withColumn("_a", F.when(have, F.col("y"))).withColumn("_b", F.col("prev_y"))
    # corr itself fails where a side is constant, even inside a condition
    spread = F.stddev_pop("_a") * F.stddev_pop("_b")
    return both.groupBy(*KEY).agg(
        F.count("y").alias("n_points"),
        F.try_divide(F.covar_pop("_a", "_b"), spread).alias("autocorr"),
    )


def treatment_facts(series: DataFrame, bounded: bool = True) -> DataFrame:
    """The per-series numbers the treatment rules read, from non-null values."""
    present = series.where(F.col("y").isNotNull())
    weekend = F.weekday("ds") >= 5
    facts = present.groupBy(*KEY).agg(
        F.count("*").alias("n_points"),
        F.count_if(weekend).alias("weekend_points"),
        F.count_if(weekend & (F.col("y") == 0)).alias("weekend_zeros"),
        F.count_if(F.col("y") == 0).alias("zeros"),
        F.floor((F.max(micros(F.col("ds"))) - F.min(micros(F.col("ds")))) / 86_400_000_000)
        .alias("days_history"),
        rules.adjusted_skew(F.col("y")).alias("skew"),
    )
    auto = lag1_autocorrelation(series, bounded).select(*KEY, "autocorr")
    return facts.join(auto, list(KEY))


def weekend_rule() -> Column:
    share = F.try_divide(F.col("weekend_zeros").cast("double"), F.col("weekend_points").cast("double"))
    return F.when(share >= rules.WEEKEND_ZERO_SHARE, "zero").otherwise("median")


def weekday_rule() -> Column:
    sticky = (F.col("n_points") > 14) & (F.col("autocorr") > rules.FFILL_AUTOCORR)
    return (
        F.when(sticky, "ffill")
        .when(F.col("days_history") > rules.YEARLY_HISTORY_DAYS, "yearly_seasonal_median")
        .when(F.col("days_history") > rules.RECENT_HISTORY_DAYS, "recent_seasonal_median")
        .otherwise("median")
    )


def intermittency_rule() -> Column:
    return F.col("zeros").cast("double") / F.col("n_points") > rules.INTERMITTENT_ZERO_SHARE


def outlier_rule() -> Column:
    return F.when(F.abs(F.col("skew")) > rules.CLIP_SKEW, "clip").otherwise("none")


def choose_treatment(facts: DataFrame) -> DataFrame:
    """Facts to one treatment row per series."""
    return facts.select(
        *KEY,
        F.when(intermittency_rule(), "zero").otherwise(weekend_rule()).alias("weekend_treatment"),
        weekday_rule().alias("weekday_treatment"),
        outlier_rule().alias("outlier_treatment"),
        intermittency_rule().alias("intermittent_smoothing"),
    )


def analyze_treatment(series: DataFrame, bounded: bool = True) -> DataFrame:
    return choose_treatment(treatment_facts(series, bounded))


# Numbers of the filling rules inside a task; any other rule is the median of the whole series.
RULE_NUMBERS = {"zero": 1, "ffill": 2, "recent_seasonal_median": 3, "yearly_seasonal_median": 4}
ZERO, FFILL, RECENT, YEARLY = RULE_NUMBERS.values()
SAME_WEEKDAY, YEAR_AGO, LAST_90 = np.arange(7, 91, 7), np.arange(358, 373), np.arange(1, 91)
BLOCK = 64  # series that are filled together


def _rule_number(rule: str) -> Column:
    number = F.lit(0)
    for name, n in RULE_NUMBERS.items():
        number = F.when(F.col(rule) == name, n).otherwise(number)
    return number.cast("int")


def _half(values: np.ndarray) -> float:
    """Median as ``percentile`` gives it; nan when there is no value."""
    n = len(values)
    ordered = np.sort(values)
    return 0.5 * ordered[(n - 1) // 2] + 0.5 * ordered[n // 2] if n else np.nan


def _quantile(ordered: np.ndarray, p: float) -> float:
    """Of sorted values, as ``percentile`` gives it."""
    at = (len(ordered) - 1) * p
    low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
    return low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high if at % 1 else low


def _capped(values: np.ndarray, clips: np.ndarray) -> np.ndarray:
    """One series' values, at most Q3 + 3·IQR of those that ``clips`` marks."""
    if not clips.any():
        return values
    ordered = np.sort(values[clips])
    q1, q3 = _quantile(ordered, 0.25), _quantile(ordered, 0.75)
    # nan counts as the greatest number, as in SQL
    return values if q3 - q1 <= 0 else np.fmin(values, q3 + rules.IQR_MULTIPLIER * (q3 - q1))


def _lagged_median(y: np.ndarray, known: np.ndarray, at: np.ndarray, start: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the known values ``lags`` days before each place, not beyond ``start``, and whether there is any."""
    back = at[:, None] - lags
    usable = back >= start[:, None]
    back = np.where(usable, back, 0)
    usable &= known[back]
    # what is not known sorts behind the values, as nan does
    ordered = np.sort(np.where(usable, y[back], np.nan), axis=1)
    n = usable.sum(axis=1)
    row = np.arange(len(at))
    return (ordered[row, np.maximum(n - 1, 0) // 2] + ordered[row, np.minimum(n // 2, len(lags) - 1)]) / 2, n > 0


def filled_days(lengths: np.ndarray, day: np.ndarray, dated: np.ndarray, value: np.ndarray, present: np.ndarray,
                weekday: np.ndarray, weekend: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all days of some series, and how many of them belong to each row. ``lengths`` counts a series' rows, which
    lie one after the other in date order, those without a date first."""
    rows, ends = np.arange(len(day)), np.cumsum(lengths)
    series = np.repeat(np.arange(len(lengths)), lengths)
    begin = (ends - lengths)[series]
    last = rows == ends[series] - 1
    step = np.where(last | ~dated, 1, np.append(day[1:], 0) - day)
    if (step < 1).any():
        raise ValueError("a series has two rows of one date")
    count = np.where(dated, step, 0)
    newest = np.maximum.accumulate(np.where(present, rows, -1)) if len(rows) else rows
    has_carried = newest >= begin
    carried = np.where(has_carried, value[newest], np.nan)

    src = np.repeat(rows, count)
    place = np.arange(len(src))
    into = place - (np.cumsum(count) - count)[src]
    own = series[src]
    start = np.searchsorted(own, np.arange(len(lengths)))[own]
    known = (into == 0) & present[src]
    y = np.where(known, value[src], np.nan)
    is_weekend = (day[src] + into + 3) % 7 >= 5  # day 0 was a Thursday
    rule = np.where(is_weekend, weekend[src], weekday[src])
    forward = weekday[src] == FFILL
    out = y.copy()
    out[~known & (rule == ZERO)] = 0.0

    median, opening, carried_median = (np.full(len(lengths), np.nan) for _ in range(3))
    for i in range(len(lengths)):
        r = slice(ends[i] - lengths[i], ends[i])
        seen, with_day = present[r], dated[r]
        median[i] = _half(value[r][seen])
        if with_day.any():
            opening[i] = _half(value[r][seen & with_day & (day[r] < day[r][with_day][0] + 30)])
        ahead = weekday[r] == FFILL
        if (ahead & ~has_carried[r]).any():
            told = ahead & has_carried[r]
            carried_median[i] = _half(np.repeat(carried[r][told], step[r][told]))
    has_value = np.bincount(series, present, minlength=len(lengths)) > 0
    has_opening = np.bincount(own, known & (place - start < 30), minlength=len(lengths)) > 0

    plain = np.flatnonzero(~known & (rule != ZERO) & (rule < RECENT) & ~forward)
    out[plain] = np.where(has_value[own[plain]], median[own[plain]], 0.0)

    todo = np.flatnonzero(~known & (rule >= RECENT) & ~forward)
    ask = todo[(rule[todo] == YEARLY) & (todo - start[todo] >= 372)]
    middle, found = _lagged_median(y, known, ask, start[ask], YEAR_AGO)
    out[ask[found]] = middle[found]
    todo = np.setdiff1d(todo, ask[found], assume_unique=True)
    middle, found = _lagged_median(y, known, todo, start[todo], SAME_WEEKDAY)
    out[todo[found]] = middle[found]
    lonely = todo[~found]
    near, found = _lagged_median(y, known & (weekday[src] >= RECENT), lonely, start[lonely], LAST_90)
    out[lonely] = np.where(found, near, np.where(has_opening[own[lonely]], opening[own[lonely]], 0.0))

    # forward fill, where chosen, runs over weekends too; zero is left for leading days
    ahead = np.flatnonzero(~known & forward)
    told = has_carried[src[ahead]]
    zero_first = is_weekend[ahead] & (weekend[src[ahead]] == ZERO)
    has_median = np.bincount(series, (weekday == FFILL) & has_carried, minlength=len(lengths)) > 0
    leading = np.where(has_median[own[ahead]] & ~zero_first, carried_median[own[ahead]], 0.0)
    out[ahead] = np.where(told, carried[src[ahead]], leading)
    return out, count


def _filled_rows(day: pa.Array, value: pa.Array, weekday: pa.Array, weekend: pa.Array, clip: pa.Array) -> pa.Array:
    """Per series and row, the values of the days from the row up to the next one. Where a row asks for ``clip``, the
    filled values are capped."""
    lengths = day.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(lengths)
    day, value, weekday, weekend, clip = (c.flatten() for c in (day, value, weekday, weekend, clip))
    clip = clip.to_numpy(zero_copy_only=False)
    dated, present = (c.is_valid().to_numpy(zero_copy_only=False) for c in (day, value))
    flat = (day.fill_null(0).to_numpy().astype(np.int64), dated, value.fill_null(0.0).to_numpy(), present,
            weekday.to_numpy(), weekend.to_numpy())
    made, counts = [np.zeros(0)], [np.zeros(0, np.int64)]
    for at in range(0, len(lengths), BLOCK):
        upto = min(at + BLOCK, len(lengths))
        rows = slice(ends[at] - lengths[at], ends[upto - 1])
        out, count = filled_days(lengths[at:upto], *(c[rows] for c in flat))
        if clip[rows].any():
            cuts = np.cumsum(np.add.reduceat(np.append(count, 0), ends[at:upto] - lengths[at:upto] - rows.start))
            out = np.concatenate(list(map(_capped, np.split(out, cuts[:-1]), np.split(np.repeat(clip[rows], count), cuts[:-1]))))
        made.append(out)
        counts.append(count)
    inner = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    outer = np.concatenate([[0], ends]).astype(np.int32)
    days = pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate(made)))
    return pa.ListArray.from_arrays(pa.array(outer), days)


def _filled_grid(series: DataFrame, key: Sequence[str], clip: Column) -> DataFrame:
    """The daily grid with its gaps filled, and capped where ``clip`` says so."""
    rest = [c for c in series.columns if c not in (*key, "ds", "y")]
    row = F.struct("ds", F.col("y").cast("double").alias("y"), F.unix_date("ds").alias("_day"), _rule_number("weekday_treatment").alias("_weekday"),
                   _rule_number("weekend_treatment").alias("_weekend"), F.coalesce(clip, F.lit(False)).alias("_clip"), *rest)
    packed = series.groupBy(*key).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    fill = F.arrow_udf(_filled_rows, "array<array<double>>")
    values = fill("_rows._day", "_rows.y", "_rows._weekday", "_rows._weekend", "_rows._clip")
    each = packed.withColumn("_values", values).select(*key, F.explode(F.arrays_zip("_rows", "_values")).alias("_e")).select(
        *key, "_e._values", F.col("_e._rows.ds").alias("_ds"), *[F.col("_e._rows")[c].alias(c) for c in rest])
    return each.select(*key, "_ds", *rest, F.posexplode("_values").alias("_into", "y")).select(
        *key, F.date_add("_ds", F.col("_into")).alias("ds"), "y", (F.col("_into") == 0).alias("was_observed"), *rest)


def impute(series: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Daily grid of a series with every missing day filled by its rule, from columns
    weekend_treatment and weekday_treatment. Rules read observed values only.

    A series is one row of its observed days while it is filled, many of them at once as
    numpy arrays: on the grid a day offset is a place offset, so the same weekday in the
    last 90 days is 12 lags and a year ago is 15, and medians are taken only where a
    value is missing. The days are then spread from the row.
    """
    return _filled_grid(series, key, F.lit(False))


def clip_outliers(series: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Cap at Q3 + 3·IQR where outlier_treatment is 'clip' and the IQR is positive."""
    clipped = F.when(F.col("outlier_treatment") == "clip", F.col("y"))
    quarters = F.percentile(clipped, F.array(F.lit(0.25), F.lit(0.75))).over(Window.partitionBy(*key))
    q1, q3 = F.col("_q")[0], F.col("_q")[1]
    cap = q3 + F.lit(rules.IQR_MULTIPLIER) * (q3 - q1)
    clips = F.coalesce(q3 - q1 > 0, F.lit(False))
    return series.withColumn("_q", quarters).withColumn(
        "y", F.when(clips, F.least(F.col("y"), cap)).otherwise(F.col("y"))
    ).drop("_q")


def clip_negative(series: DataFrame, allow_negative: bool = False) -> DataFrame:
    return series if allow_negative else series.withColumn("y", F.greatest(F.col("y"), F.lit(0.0)))


def clean(series: DataFrame, key: Sequence[str] = KEY, allow_negative: bool = False) -> DataFrame:
    """Grid and impute, clip outliers, clip negatives: one cleaned daily series per key. The cap of ``clip_outliers`` is
    worked out where the series is filled."""
    return clip_negative(_filled_grid(series, key, F.col("outlier_treatment") == "clip"), allow_negative)


def _median(ordered: list[float]) -> float:
    """Median of a sorted list; nan when it is empty."""
    n = len(ordered)
    if not n:
        return math.nan
    return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


def filled_in_order(values: np.ndarray, dow: list[int], weekday: str, weekend: str) -> list[float]:
    """The values of one series with every nan filled by its rule. What lies before a gap is filled already, so its
    windows are short slices of known values; the median of the whole series is kept in a sorted list."""
    y = values.tolist()
    rules_of = [weekend if d >= 5 else weekday for d in dow]
    gaps = np.flatnonzero(np.isnan(values)).tolist()
    whole = any(rules_of[i] not in ("zero", "yearly_seasonal_median", "recent_seasonal_median") for i in gaps)
    known = np.sort(values[~np.isnan(values)]).tolist() if whole else []

    def recent(i: int) -> float:
        if i == 0:
            return _median(sorted(v for v in y[:30] if v == v))
        lo = max(0, i - 90)
        same = [v for v, d in zip(y[lo:i], dow[lo:i]) if d == dow[i]]
        return _median(sorted(same or y[lo:i]))

    for i in gaps:
        rule = rules_of[i]
        if rule == "zero":
            value = 0.0
        elif rule == "yearly_seasonal_median" and i >= 372:
            value = _median(sorted(y[i - 372:i - 357]))
        elif rule in ("yearly_seasonal_median", "recent_seasonal_median"):
            value = recent(i)
        else:
            value = _median(known)
        y[i] = 0.0 if math.isnan(value) else value
        if whole:
            bisect.insort(known, y[i])
    return y


def impute_in_order(series: DataFrame) -> DataFrame:
    """The order-dependent form of ``impute``: each filled value is visible to later windows.

    Per-series fold over one bounded daily series; use it only where results must
    include earlier fills. ``impute`` is the parallel default.
    """
    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ds")
        weekday, weekend = (rows.column(c)[0].as_py() for c in ("weekday_treatment", "weekend_treatment"))
        values = rows.column("y").to_numpy().astype(float)
        if weekday == "ffill":
            values = pd.Series(values).ffill().to_numpy()
        dow = (rows.column("ds").cast(pa.int32()).to_numpy() + 3) % 7  # day 0 was a Thursday
        at = rows.column_names.index("y")
        y = pa.array(filled_in_order(values, dow.tolist(), weekday, weekend), pa.float64(), from_pandas=True)
        return rows.set_column(at, rows.field(at), y.cast(rows.field(at).type))

    grid = daily_grid(series)
    return grid.groupBy(*KEY).applyInArrow(fold, grid.schema)


def split_cutoff(series: DataFrame, test_window: int) -> DataFrame:
    """Per series: row count (nulls included), holdout size and the first test date.

    The newest rows are found with a bounded rank, which Spark applies before the
    shuffle, so a dense series never moves as a whole.
    """
    counts = series.groupBy(*KEY).agg(F.count("*").alias("n"))
    most = max(rules.MIN_HOLDOUT, int(test_window))
    newest = series.select(*KEY, "ds").withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("ds")))
    ).where(F.col("_rank") <= F.lit(most))
    sized = newest.join(counts, list(KEY)).withColumn("holdout", rules.holdout_size(F.col("n"), test_window))
    return sized.groupBy(*KEY).agg(
        F.first("n").alias("n"), F.first("holdout").alias("holdout"),
        F.min(F.when(F.col("_rank") <= F.col("holdout"), F.col("ds"))).alias("test_start"),
    ).withColumn("status", F.when(F.col("n") < rules.MIN_SPLIT_POINTS, "too_short").otherwise("ready"))


def split_parts(series: DataFrame, cutoff: DataFrame, bounded: bool = True) -> DataFrame:
    """Tag rows with part 'train' or 'test'."""
    starts = cutoff.where("status = 'ready'").select(*KEY, "test_start")
    return with_facts(series, starts, bounded).withColumn(
        "part", F.when(F.col("ds") < F.col("test_start"), "train").otherwise("test")
    ).drop("test_start")


def clean_views(series: DataFrame, treatment: DataFrame, cutoff: DataFrame, allow_negative: bool = False) -> DataFrame:
    """(series_id, part, ds, y): train, test and full, each gridded and cleaned on
    its own with the same treatment. The test view never sees training values."""
    facts = treatment.join(cutoff.where("status = 'ready'").select(*KEY, "test_start"), list(KEY))
    own = F.when(F.col("ds") < F.col("test_start"), "train").otherwise("test")
    parts = with_facts(series, facts).withColumn("part", F.explode(F.array(own, F.lit("full")))).drop("test_start")
    key = ("series_id", "part")
    return clean(parts, key, allow_negative).select(*key, "ds", "y", "was_observed")


def gap_facts(series: DataFrame, bounded: bool = True) -> DataFrame:
    """Median and extreme gaps between consecutive timestamps, in days."""
    if bounded:
        w = Window.partitionBy(*KEY).orderBy("ds")
        stepped = series.withColumn("prev_ds", F.lag("ds").over(w))
    else:
        stepped = previous_reading(series, KEY, "ds", ["ds"])
    gaps = stepped.where(F.col("prev_ds").isNotNull()).withColumn(
        "gap", (micros(F.col("ds")) - micros(F.col("prev_ds"))) / F.lit(86_400_000_000.0)
    )
    month_start = (F.dayofmonth("ds") == 1) & (F.dayofmonth("prev_ds") == 1)
    facts = gaps.groupBy(*KEY).agg(
        F.count("*").alias("n_gaps"), F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"),
        F.min(month_start).alias("month_starts"),
    )
    if bounded:
        middle = gaps.groupBy(*KEY).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    else:
        middle = exact_percentiles(gaps, KEY, "gap", {"median_gap": 0.5})
    return facts.join(middle, list(KEY))


def frequency_of() -> Column:
    """Frequency from gap facts: a regular spacing is taken as is, else the median
    gap decides."""
    several = F.col("n_gaps") >= 2
    regular = several & (F.col("min_gap") == F.col("max_gap"))
    hour = 1.0 / 24
    g = F.col("median_gap")
    return (
        F.when(several & F.col("month_starts") & (F.col("min_gap") >= 28) & (F.col("max_gap") <= 31), "MS")
        .when(regular & (F.col("min_gap") == 1), "D").when(regular & (F.col("min_gap") == 7), "W")
        .when(g <= hour, "h").when(g <= 4 * hour, "4h").when(g <= 1, "D")
        .when(g <= 7, "W").when(g <= 31, "MS").otherwise("D")
    )


def frequency(gaps: DataFrame) -> DataFrame:
    return gaps.select(*KEY, "median_gap", frequency_of().alias("freq"))


# Observations per season for each frequency; 7 when not listed.
SEASONAL_PERIODS = {"D": 7, "B": 5, "W": 52, "MS": 12, "QS": 4, "AS": 1, "H": 24, "T": 60}


def seasonal_period(freq: Column) -> Column:
    period = F.lit(7)
    for name, value in SEASONAL_PERIODS.items():
        period = F.when(F.upper(freq) == name, value).otherwise(period)
    return period


def future_calendar(last_seen: DataFrame) -> DataFrame:
    """Dates after the last observation: (series_id, last_ds, freq, horizon) to
    (series_id, step, ds)."""
    step = F.explode(F.sequence(F.lit(1), F.col("horizon"))).alias("step")
    last = F.col("last_ds").cast("timestamp_ntz")
    hours = F.when(F.col("freq") == "h", 1).when(F.col("freq") == "4h", 4)
    ahead = (
        F.when(F.col("freq") == "MS", F.add_months(F.trunc(F.col("last_ds").cast("date"), "month"), F.col("step")).cast("timestamp_ntz"))
        .when(hours.isNotNull(), last + F.make_dt_interval(hours=F.col("step") * hours))
        .when(F.col("freq") == "W", last + F.make_dt_interval(days=F.col("step") * 7))
        .otherwise(last + F.make_dt_interval(days=F.col("step")))
    )
    return last_seen.select("*", step).select(*KEY, "step", ahead.alias("ds"))


def column_health(long: DataFrame, by: str = "metric") -> DataFrame:
    """Health figures per column of an unpivoted table (``by``, y)."""
    n = F.col("total")
    stats = long.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("y").isNull()).alias("missing"),
        F.count_if(F.col("y") == 0).alias("zeros"), F.count_if(F.col("y") < 0).alias("negatives"),
        F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"),
        rules.adjusted_skew(F.col("y")).alias("skew"), F.min("y").alias("min"), F.max("y").alias("max"),
    )
    rounded = [F.round(c, 2).alias(c) for c in ("mean", "std", "skew", "min", "max")]
    return stats.select(
        by, F.when(F.col("missing") == n, "Empty").otherwise("Ok").alias("status"), "total", "missing",
        F.round(F.col("missing") / n * 100, 1).alias("missing_pct"), "zeros", "negatives", *rounded,
    )


def align_covariates(targets: DataFrame, covariates: DataFrame) -> DataFrame:
    """Cleaned covariates (series_id, x_name, ds, y) on the target's dates: the last
    known value is carried forward, and 0 stands before the first one."""
    names = covariates.select(*KEY, "x_name").distinct()
    wanted = targets.select(*KEY, "ds").distinct().join(names, list(KEY))
    marked = wanted.withColumn("_wanted", F.lit(True)).withColumn("y", F.lit(None).cast("double")).unionByName(
        covariates.select(*KEY, "ds", "x_name", "y").withColumn("_wanted", F.lit(False))
    )
    per_day = marked.groupBy(*KEY, "x_name", "ds").agg(F.max("_wanted").alias("_wanted"), F.max("y").alias("x"))
    # only readings on a target date count as seen: carry those forward
    kept = per_day.where("_wanted")
    w = Window.partitionBy(*KEY, "x_name").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    return kept.select(*KEY, "x_name", "ds", F.coalesce(F.last("x", ignorenulls=True).over(w), F.lit(0.0)).alias("x"))
