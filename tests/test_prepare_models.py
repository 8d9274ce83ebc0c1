"""Preparation and models against brute force on small series."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from seriesloom.functions import spread
from seriesloom.operators import demand as D, features as X, holidays as HD, models as G, pooled as PO, prepare as P, smoothing as S
from seriesloom.sources import generators

DAY = dt.date(2021, 1, 1)


def frame(spark, series: dict[str, list[tuple[int, float | None]]]):
    rows = [(k, DAY + dt.timedelta(int(i)), None if v is None else float(v)) for k, pts in series.items() for i, v in pts]
    return spark.createDataFrame(rows, "series_id string, ds date, y double")


def brute_fill(values: list[float | None], first: dt.date, weekday: str, weekend: str) -> list[float]:
    """Order-independent fill rules, written as loops over one series."""
    y = np.array([np.nan if v is None else v for v in values], float)

    def med(v):
        v = v[~np.isnan(v)]
        return float(np.median(v)) if v.size else np.nan
    out, carried = y.copy(), pd.Series(y).ffill().to_numpy()
    for i in np.flatnonzero(np.isnan(y)):
        end = (first + dt.timedelta(int(i))).weekday() >= 5
        rule = weekend if end else weekday
        lo = max(0, i - 90)
        near = y[lo:i]
        recent = next((m for m in (med(near[[(i - j) % 7 == 0 for j in range(lo, i)]]) if i else np.nan, med(near), med(y[:30])) if not np.isnan(m)), 0.0)
        if weekday == "ffill":
            value = carried[i] if not np.isnan(carried[i]) else (0.0 if end and weekend == "zero" else med(carried))
        elif rule == "zero":
            value = 0.0
        elif rule == "median":
            value = med(y)
        else:
            year = med(y[i - 372:i - 357]) if rule.startswith("yearly") and i >= 372 else np.nan
            value = recent if np.isnan(year) else year
        out[i] = 0.0 if np.isnan(value) else value
    return out.tolist()


@pytest.mark.parametrize("weekday", ["median", "ffill", "recent_seasonal_median", "yearly_seasonal_median", "zero"])
@pytest.mark.parametrize("weekend", ["median", "zero"])
def test_impute_equals_brute_force(spark, weekday, weekend):
    rng = random.Random(7)
    series, dense = {}, {}
    for name, keep in (("sparse", 0.05), ("half", 0.5), ("full", 0.97)):
        n = 800
        values = [float(rng.randint(0, 50)) if rng.random() < keep else None for _ in range(n)]
        values[-1] = 5.0
        dense[name] = values
        # the first dates are present without a value, as null readings are
        series[name] = [(i, v) for i, v in enumerate(values) if v is not None or i < 3]
    ready = frame(spark, series).select("*", F.lit(weekday).alias("weekday_treatment"), F.lit(weekend).alias("weekend_treatment"))
    got = P.impute(ready).toPandas().sort_values(["series_id", "ds"])
    for name, values in dense.items():
        assert got[got.series_id == name].y.tolist() == pytest.approx(brute_fill(values, DAY, weekday, weekend)), name


def test_clean_fills_and_caps_without_a_window_over_days(spark):
    rng = random.Random(3)
    values = {k: [(i, rng.choice([None, 1.0, 2.0, 3.0, 400.0, -2.0])) for i in range(500) if rng.random() < keep] for k, keep in (("thin", 0.1), ("thick", 0.7))}
    values["empty"], values["one"] = [(0, None), (9, None)], [(5, 7.0)]
    rules = [F.lit("yearly_seasonal_median").alias("weekday_treatment"), F.lit("zero").alias("weekend_treatment"),
             F.when(F.col("series_id") != "thick", "clip").otherwise("none").alias("outlier_treatment")]
    nowhere = spark.createDataFrame([("thin", None, 2.0), (None, DAY, 1.0), (None, DAY + dt.timedelta(4), 3.0)], "series_id string, ds date, y double")
    ready = frame(spark, values).unionByName(nowhere).select("*", *rules)
    cleaned, steps = P.clean(ready), P.clip_negative(P.clip_outliers(P.impute(ready)))
    assert cleaned.columns == steps.columns
    assert sorted(map(repr, cleaned.collect())) == sorted(map(repr, steps.collect()))
    # no sorted buffer of stretched days, each with its last 90, and no sort of them
    assert "Window" not in cleaned._jdf.queryExecution().optimizedPlan().toString()


def test_in_order_form_agrees_when_gaps_are_far_apart(spark):
    rows = [(i, float(i % 11)) for i in range(500) if i not in (200, 450)]
    ready = frame(spark, {"s": rows}).select("*", F.lit("recent_seasonal_median").alias("weekday_treatment"), F.lit("median").alias("weekend_treatment"))
    a = P.impute(ready).toPandas().sort_values("ds").y.tolist()
    assert a == pytest.approx(P.impute_in_order(ready).toPandas().sort_values("ds").y.tolist())


def test_keep_last_prefers_a_null_last_value(spark):
    rows = [("s", 1, DAY, 1.0), ("s", 2, DAY, None), ("t", 1, DAY, None), ("t", 2, DAY, 9.0)]
    got = {r["series_id"]: (r["y"], r["duplicates"]) for r in P.keep_last(spark.createDataFrame(rows, "series_id string, row_no int, ds date, y double")).collect()}
    assert got == {"s": (None, 1), "t": (9.0, 1)}


def test_grid_keeps_the_first_time_of_day(spark):
    first = dt.datetime(2024, 1, 1, 10)
    rows = [("s", first + dt.timedelta(hours=12 * i), float(i)) for i in range(6)]
    grid = P.daily_grid(P.on_daily_grid(spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")).select("series_id", "ds", "y"))
    assert [(r["ds"].day, r["y"]) for r in grid.orderBy("ds").collect()] == [(1, 0.0), (2, 2.0), (3, 4.0)]


def test_spread_helpers_equal_the_plain_forms(spark):
    """A third of all rows belong to one key; small pieces force the spread paths."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i * 37), float(rng.randint(0, 400))) for i in range(6000)]
    table = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")
    want = table.groupBy("series_id").agg(*[F.percentile("y", F.lit(p)).alias(n) for n, p in (("lo", 0.1), ("mid", 0.5), ("hi", 0.99))])
    got = spread.exact_percentiles(table, ["series_id"], "y", {"lo": 0.1, "mid": 0.5, "hi": 0.99}, accuracy=200)
    found = {r[0]: tuple(r)[1:] for r in got.select("series_id", "lo", "mid", "hi").collect()}
    assert found == {r[0]: pytest.approx(tuple(r)[1:]) for r in want.collect()}
    lagged = spread.previous_reading(table, ["series_id"], "ds", ["y"], target_rows=100)
    plain = table.withColumn("prev_y", F.lag("y").over(Window.partitionBy("series_id").orderBy("ds")))
    assert sorted(lagged.select("series_id", "ds", "prev_y").collect(), key=str) == sorted(plain.select("series_id", "ds", "prev_y").collect(), key=str)


def test_frequency(spark):
    def steps(name, days):
        return [(name, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 1.0) for d in days]
    rows = steps("d", range(40)) + steps("w", range(0, 280, 7)) + steps("h", [i / 24 for i in range(60)]) + steps("odd", [0, 1, 3, 4, 6, 7, 9, 12]) + [
        ("m", dt.datetime(2023 + i // 12, i % 12 + 1, 1), 1.0) for i in range(20)]
    table = spark.createDataFrame(rows, "series_id string, ds timestamp_ntz, y double")
    want = {"d": "D", "w": "W", "h": "h", "odd": "W", "m": "MS"}
    for bounded in (True, False):
        assert {r["series_id"]: r["freq"] for r in P.frequency(P.gap_facts(table, bounded)).collect()} == want


def fits(spark, series: dict[str, list[float]]):
    return frame(spark, {k: list(enumerate(v)) for k, v in series.items()}).withColumn("kind", F.lit("future"))


def ahead(spark, names: list[str], steps: int, start: int):
    rows = [(n, "future", s, DAY + dt.timedelta(start + s - 1)) for n in names for s in range(1, steps + 1)]
    return spark.createDataFrame(rows, "series_id string, kind string, step int, ds date")


def forecast(df) -> dict[str, list[float]]:
    out: dict[str, list[float]] = {}
    for r in df.orderBy("series_id", "step").collect():
        out.setdefault(r["series_id"], []).append(r["yhat"])
    return out


def test_closed_form_models(spark):
    series = {"line": [2.0 * i + 3 for i in range(100)], "rare": [float(10 if i % 4 == 1 else 0) for i in range(100)], "none": [0.0] * 100, "once": [0.0] * 50 + [8.0] + [0.0] * 49}
    rows, wanted = fits(spark, series), ahead(spark, list(series), 3, 100)
    assert forecast(G.predict_linear(rows, wanted))["line"] == pytest.approx([203.0, 205.0, 207.0])
    croston = forecast(G.predict_croston(rows, wanted))
    assert croston["rare"] == pytest.approx([2.5] * 3) and croston["none"] == [0.0] * 3 and croston["once"] == pytest.approx([8.0] * 3)
    level = {r["series_id"]: r["level"] for r in S.fit_ses(fits(spark, {"flat": [4.0] * 60, "step": [1.0] * 30 + [9.0] * 30})).collect()}
    assert level["flat"] == pytest.approx(4.0) and level["step"] == pytest.approx(9.0, abs=0.01)


def test_numeric_models(spark):
    t = np.arange(420)
    weekly = 50 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 7)
    series = {"flat": [6.0] * 420, "weekly": weekly.tolist(), "short": [1.0, 2.0, 3.0]}
    rows, wanted = fits(spark, series), ahead(spark, list(series), 14, 420)
    future = np.arange(420, 434)
    truth = 50 + 0.1 * future + 10 * np.sin(2 * np.pi * future / 7)
    hw = forecast(S.paths_to_predictions(S.fit_holt_winters(rows, wanted), wanted))
    assert hw["flat"] == pytest.approx([6.0] * 14) and hw["weekly"] == pytest.approx(truth.tolist(), rel=0.02) and len(hw["short"]) == 14
    harmonic = forecast(S.paths_to_predictions(S.fit_harmonic(rows, wanted, cycles={7.0: 3}), wanted))
    assert harmonic["weekly"] == pytest.approx(truth.tolist(), rel=1e-6)
    paths = S.fit_differenced_ar(rows, wanted)
    failed = {r["series_id"]: r["error"] for r in paths.where("error is not null").collect()}
    ar = forecast(S.paths_to_predictions(paths, wanted))
    # a series that cannot be fitted reports why and leaves the others alone
    assert set(failed) == {"short"} and set(ar) == {"flat", "weekly"} and ar["flat"] == pytest.approx([6.0] * 14)


def test_pooled_models_and_recursion(spark):
    t, rng = np.arange(240), np.random.default_rng(5)
    series = {f"s{k}": (20 * k + 5 * k * np.sin(2 * np.pi * t / 7) + rng.normal(0, 0.2 * k, 240)).tolist() for k in range(1, 5)}
    table = frame(spark, {k: list(enumerate(v)) for k, v in series.items()})
    views = table.withColumn("part", F.lit("train"))
    rows, wanted = table.withColumn("kind", F.lit("future")), ahead(spark, list(series), 14, 240)
    future = np.arange(240, 254)
    for name, tolerance in (("Ridge", 0.10), ("Huber", 0.15), ("ExtraTrees", 0.25)):
        made, model = PO.fit_pooled(name, views, rows, wanted)
        got = forecast(made)
        for k in range(1, 5):
            assert got[f"s{k}"] == pytest.approx((20 * k + 5 * k * np.sin(2 * np.pi * future / 7)).tolist(), rel=tolerance), name
        assert PO.feature_importance(model, name, table).count() <= 10
    low, _ = PO.fit_pooled("LightGBM", views, rows, wanted, q=0.1, trees=30)
    high, _ = PO.fit_pooled("LightGBM", views, rows, wanted, q=0.9, trees=30)
    assert sum(sum(v) for v in forecast(low).values()) < sum(sum(v) for v in forecast(high).values())


def test_features(spark):
    y = [float((i * 7) % 13) for i in range(60)]
    table = frame(spark, {"s": list(enumerate(y))})
    got = X.univariate_features(table).toPandas().sort_values("ds").reset_index(drop=True)
    s = pd.Series(y)
    assert got.roll_mean_7.tolist() == pytest.approx(s.shift(1).rolling(7, min_periods=1).mean().fillna(0).tolist())
    assert got.roll_std_7.tolist() == pytest.approx(s.shift(1).rolling(7, min_periods=2).std().ffill().fillna(0).tolist())
    strict = X.strict_rolling_stats(table).toPandas().sort_values("ds").reset_index(drop=True)
    assert strict.roll_mean_28.isna().sum() == 28 and strict.roll_max_3.iloc[0] == 0
    decomposed = X.decompose(frame(spark, {"s": [(i, 10 + [3, 1, 0, -1, -2, -3, 2][i % 7]) for i in range(70)]})).where("trend is not null").toPandas()
    assert decomposed.residual.abs().max() < 1e-9 and decomposed.trend.tolist() == pytest.approx([10.0] * len(decomposed))


def test_holidays(spark):
    years = spark.createDataFrame([(y,) for y in (2023, 2024)], "year int")
    got = {(r["region"], r["name"], r["holiday"]) for r in HD.holiday_table(years, ["us", "GB", "nowhere"]).collect()}
    for want in (("US", "Thanksgiving", dt.date(2024, 11, 28)), ("US", "Memorial Day", dt.date(2024, 5, 27)), ("GB", "Good Friday", dt.date(2024, 3, 29)),
                 ("GB", "Easter Monday", dt.date(2023, 4, 10)), ("US", "Labor Day", dt.date(2023, 9, 4))):
        assert want in got
    assert {r for r, _, _ in got} == {"US", "GB"}
    days = frame(spark, {"s": [(i, 1.0) for i in range(10)]})
    flags = {r["ds"].day: tuple(r)[3:] for r in HD.with_holidays(days, ["US"]).collect()}
    assert flags[1] == (1, 0, 0, 0) and flags[2] == (0, 0, 1, 0) and flags[3] == (0, 0, 0, 1) and flags[5] == (0, 0, 0, 0)


def test_generated_series_land_in_their_quadrant(spark):
    keys = spark.createDataFrame([(f"g{i}",) for i in range(5)], "series_id string")
    for build, kind in ((generators.smooth_retail, "Smooth"), (generators.intermittent_parts, "Intermittent"), (generators.lumpy_parts, "Lumpy")):
        rows = D.demand_profile(build(keys)).collect()
        assert {r["demand_type"] for r in rows} == {kind} and {r["periods"] for r in rows} == {730}
    assert generators.trend_season_demo(keys).count() == 5 * 732
    a, b = (generators.lumpy_parts(keys).orderBy("series_id", "ds").collect() for _ in range(2))
    assert a == b


def test_feature_screening(spark):
    rng = np.random.default_rng(2)
    x, noise = rng.normal(0, 1, 2000), rng.normal(0, 1, 2000)
    rows = [(float(a), float(b), float(i % 12), float(a * a + 0.05 * c)) for i, (a, b, c) in enumerate(zip(x, noise, rng.normal(0, 1, 2000)))]
    names = ["signal", "noise", "month_sin"]
    table = spark.createDataFrame(rows, "signal double, noise double, month_sin double, y double")
    got = {r["feature"]: r for r in PO.screen_features(table, names, top=1, cumulative=0.5, trees=5, depth=4).collect()}
    # the target is an even function of the signal: no correlation, much information
    assert got["signal"]["mi"] > 10 * got["noise"]["mi"] and got["signal"]["importance"] > 0.9
    assert got["signal"]["kept"] and got["month_sin"]["kept"] and not got["noise"]["kept"]


def test_harmonic_regression_forecasts_at_the_dates(spark):
    first = dt.date(2023, 1, 2)
    rows = spark.createDataFrame([("s", "test", first + dt.timedelta(i), 100.0 + i) for i in range(200)], "series_id string, kind string, ds date, y double")
    weekly = [(k, first + dt.timedelta(199 + 7 * k)) for k in range(1, 6)]
    wanted = S.days_ahead(rows, spark.createDataFrame([("s", "test", k, d) for k, d in weekly], "series_id string, kind string, step int, ds date"))
    got = {r["step"]: r["yhat"] for r in S.paths_to_predictions(S.fit_harmonic(rows, wanted, cycles={}), wanted).collect()}
    assert got == pytest.approx({k: 299.0 + 7 * k for k in range(1, 6)})


def test_pooled_models_forecast_short_series(spark):
    t = np.arange(90)
    series = {"long": (50 + 10 * np.sin(2 * np.pi * t / 7)).tolist(), "short": (80 + 16 * np.sin(2 * np.pi * t[:25] / 7)).tolist()}
    table = frame(spark, {k: list(enumerate(v)) for k, v in series.items()})
    views, rows = table.withColumn("part", F.lit("train")), table.withColumn("kind", F.lit("test"))
    wanted = frame(spark, {k: [(len(v) + i, 0.0) for i in range(9)] for k, v in series.items()}).withColumn("kind", F.lit("test")).withColumn(
        "step", F.row_number().over(Window.partitionBy("series_id").orderBy("ds"))).drop("y")
    made, _ = PO.fit_pooled("Ridge", views, rows, wanted)
    got = made.groupBy("series_id").agg(F.count("yhat").alias("n"), F.min("yhat").alias("least"), F.max("yhat").alias("most")).collect()
    assert {r["series_id"]: r["n"] for r in got} == {"long": 9, "short": 9}
    assert all(40 < r["least"] and r["most"] < 120 for r in got if r["series_id"] == "short")
    train = views.select("series_id", "ds", "y")
    assert PO.training_frame(train, PO.scales(train)).count() == 115
