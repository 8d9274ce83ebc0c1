"""Queries for features and forecast models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.operators import changepoints as CP, features as X, holidays as HD, metrics as M, models as G, pooled as PO, prepare as P, smoothing as S
from seriesloom.plans.inputs import ctes, load, reading_tasks
from seriesloom.plans.prepare_queries import FREQ, GAPS, GRID_CTES, SKEW, TEST_WINDOW, VIEW_CTES, supplier_grid, treated, views
from seriesloom.plans.registry import query
from seriesloom.session import materialize

FILLED_CTES = GRID_CTES.rstrip() + ", f AS (SELECT series_id, ds, coalesce(y, 0.0) AS y FROM grid)\n"
W = "(PARTITION BY series_id ORDER BY ds)"
PAST = "(PARTITION BY series_id ORDER BY ds ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def filled(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_grid(spark, sf).select("series_id", "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.select("series_id", "ds", *[F.round(c, digits).alias(c) for c in columns])


# ---- features ------------------------------------------------------------------
@query("f01_fixed_lags", FILLED_CTES + "SELECT series_id, ds, " + ", ".join(f"lag(y, {k}) OVER {W} AS lag_{k}" for k in X.LAGS) + " FROM f")
def f01(spark: SparkSession, sf: str) -> DataFrame:
    return X.fixed_lags(filled(spark, sf)).drop("y")


def _stat(fn: str, k: int) -> str:
    return f"{fn}(y) OVER {PAST.format(k=k)}"


def _ffill(expr: str, start: str = "0.0") -> str:
    return f"coalesce(last_value({expr} IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {start})"


@query("f02_rolling_stats", FILLED_CTES.rstrip() + f", r AS (SELECT series_id, ds, {_stat('avg', 7)} AS roll_mean_7, {_stat('avg', 14)} AS roll_mean_14, {_stat('avg', 28)} AS roll_mean_28, {_stat('max', 7)} AS roll_max_7, {_stat('stddev_samp', 7)} AS sd FROM f)\n"
       + f"SELECT series_id, ds, round(roll_mean_7, 4) AS roll_mean_7, round(roll_mean_14, 4) AS roll_mean_14, round(roll_mean_28, 4) AS roll_mean_28, round(roll_max_7, 4) AS roll_max_7, round({_ffill('sd')}, 4) AS roll_std_7 FROM r")
def f02(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.rolling_stats(filled(spark, sf)), "roll_mean_7", "roll_mean_14", "roll_mean_28", "roll_max_7", "roll_std_7")


def _full(fn: str, k: int) -> str:
    return f"CASE WHEN count(y) OVER {PAST.format(k=k)} = {k} THEN {_stat(fn, k)} END"


STRICT = ("SELECT series_id, ds, y, " + ", ".join(f"{_full('max', k)} AS roll_max_{k}" for k in (7, 14, 28)) + ", "
          + ", ".join(f"{_full('avg', k)} AS roll_mean_{k}" for k in (7, 28))
          + f", {_full('max', 3)} AS m3, {_full('stddev_samp', 7)} AS s7, {_full('stddev_samp', 28)} AS s28 FROM f")
STRICT_FULL = f"SELECT *, {_ffill('m3')} AS roll_max_3, {_ffill('s7')} AS roll_std_7, {_ffill('s28', '1e-6')} AS roll_std_28 FROM s0"
STRICT_CTES = FILLED_CTES.rstrip() + f", s0 AS ({STRICT}), s AS ({STRICT_FULL})\n"
_STRICT = ("roll_max_3", "roll_max_7", "roll_max_14", "roll_max_28", "roll_mean_7", "roll_mean_28", "roll_std_7")


@query("f03_strict_rolling_stats", STRICT_CTES + "SELECT series_id, ds, " + ", ".join(f"round({c}, 4) AS {c}" for c in _STRICT) + " FROM s")
def f03(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.strict_rolling_stats(filled(spark, sf)), *_STRICT)


CAL = """isodow(ds) - 1 AS dow, month(ds) AS month, day(ds) AS dom, dayofyear(ds) AS doy, weekofyear(ds) AS week, quarter(ds) AS quarter, CAST(ds = last_day(ds) AS INT) AS is_month_end,
  CAST(day(ds) = 1 AS INT) AS is_month_start, CAST(isodow(ds) > 5 AS INT) AS is_weekend, CAST(isodow(ds) = 1 AS INT) AS is_monday"""


@query("f04_calendar", ctes("supplier_daily") + f"SELECT series_id, ds, {CAL} FROM supplier_daily")
def f04(spark: SparkSession, sf: str) -> DataFrame:
    return X.calendar(load(spark, sf, "supplier_daily")).drop("y")


_CYC = [(n, size, fn) for n, size in (("month", 12), ("dow", 7), ("quarter", 4), ("week", 52)) for fn in ("sin", "cos")]


@query("f05_cyclical", ctes("supplier_daily", c=f"SELECT series_id, ds, {CAL} FROM supplier_daily") + "SELECT series_id, ds, "
       + ", ".join(f"round({fn}(2 * pi() * {n} / {size}), 6) + 0.0 AS {n}_{fn}" for n, size, fn in _CYC) + " FROM c")
def f05(spark: SparkSession, sf: str) -> DataFrame:
    made = X.cyclical(X.calendar(load(spark, sf, "supplier_daily")))
    return made.select("series_id", "ds", *[(F.round(f"{n}_{fn}", 6) + 0.0).alias(f"{n}_{fn}") for n, _, fn in _CYC])


_YEARS = "SELECT unnest(generate_series(CAST(year(MIN(ds)) - 1 AS BIGINT), CAST(year(MAX(ds)) + 1 AS BIGINT))) AS y FROM supplier_daily"


@query("f06_holiday_calendar", ctes("supplier_daily", ys=_YEARS) + """
SELECT region, h AS holiday, name FROM (
  SELECT 'US' AS region, make_date(y, 7, 4) AS h, 'Independence Day' AS name FROM ys UNION ALL SELECT 'US', make_date(y, 1, 1), 'New Year''s Day' FROM ys UNION ALL
  SELECT 'US', make_date(y, 12, 25), 'Christmas Day' FROM ys UNION ALL SELECT 'US', make_date(y, 11, 11), 'Veterans Day' FROM ys UNION ALL SELECT 'US', make_date(y, 6, 19), 'Juneteenth' FROM ys UNION ALL
  SELECT 'US', MIN(d) FILTER (WHERE isodow(d) = dw AND day(d) > lo), name FROM (SELECT y, CAST(unnest(generate_series(make_date(y, m, 1), last_day(make_date(y, m, 1)), INTERVAL 1 DAY)) AS DATE) AS d, dw, lo, name
    FROM ys, (VALUES (1, 1, 14, 'Martin Luther King Jr. Day'), (2, 1, 14, 'Washington''s Birthday'), (9, 1, 0, 'Labor Day'), (10, 1, 7, 'Columbus Day'), (11, 4, 21, 'Thanksgiving'), (5, 1, 24, 'Memorial Day')) v(m, dw, lo, name)) x GROUP BY y, name) t""")
def f06(spark: SparkSession, sf: str) -> DataFrame:
    return HD.holiday_table(HD.data_years(load(spark, sf, "supplier_daily")), ["us", "xx"])


@query("f07_holiday_features", ctes("supplier_daily", h="""SELECT DISTINCT make_date(y, m, d) AS h FROM (SELECT unnest(generate_series(1990, 2010)) AS y) ys, (VALUES (1, 26), (5, 1), (8, 15), (10, 2), (12, 25)) v(m, d)
  UNION SELECT e - 2 FROM (VALUES (DATE '1995-04-16'), (DATE '1996-04-07'), (DATE '1997-03-30'), (DATE '1998-04-12'), (DATE '1999-04-04'), (DATE '2000-04-23'), (DATE '2001-04-15'), (DATE '2002-03-31'), (DATE '1994-04-03')) z(e)""") + """
SELECT series_id, ds, CAST(ds IN (SELECT h FROM h) AS INT) AS is_holiday, CAST(ds + 1 IN (SELECT h FROM h) AS INT) AS before_holiday_1, CAST(ds - 1 IN (SELECT h FROM h) AS INT) AS after_holiday_1,
  CAST(ds - 2 IN (SELECT h FROM h) AS INT) AS after_holiday_2 FROM supplier_daily""")
def f07(spark: SparkSession, sf: str) -> DataFrame:
    return HD.with_holidays(load(spark, sf, "supplier_daily"), ["IN"]).drop("y")


ACF = """SELECT series_id, n, lag, SUM(c * cl) / MAX(v) AS acf FROM (
    SELECT c.series_id, c.n, k.lag, c.c, l.c AS cl, c.v FROM c JOIN (SELECT CAST(unnest(generate_series(1, 40)) AS INT) AS lag) k ON true LEFT JOIN c l ON l.series_id = c.series_id AND l.rn = c.rn - k.lag) x
  WHERE lag <= n // 2 - 1 GROUP BY 1, 2, 3"""
CENTRED = """SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS rn, COUNT(*) OVER p AS n, y - AVG(y) OVER p AS c, VAR_POP(y) OVER p * COUNT(*) OVER p AS v FROM f WINDOW p AS (PARTITION BY series_id)"""
ACF_CTES = FILLED_CTES.rstrip() + f", c AS ({CENTRED}), acf AS ({ACF})\n"


@query("f08_autocorrelation", ACF_CTES + "SELECT series_id, CAST(n AS BIGINT) AS n, lag, round(acf, 6) AS acf FROM acf")
def f08(spark: SparkSession, sf: str) -> DataFrame:
    return X.autocorrelations(filled(spark, sf)).withColumn("acf", F.round("acf", 6))


SIG = "SELECT series_id, list_slice(list(lag ORDER BY lag), 1, 10) AS lags FROM acf WHERE lag = 1 OR abs(acf) > 1.96 / sqrt(n) GROUP BY 1"


@query("f09_significant_lags", ACF_CTES.rstrip() + f", sig AS ({SIG})\nSELECT series_id, array_to_string(lags, ',') AS lags FROM sig")
def f09(spark: SparkSession, sf: str) -> DataFrame:
    return X.significant_lags(X.autocorrelations(filled(spark, sf))).select("series_id", F.concat_ws(",", "lags").alias("lags"))


@query("f10_dynamic_lags", ACF_CTES.rstrip() + f""", sig AS ({SIG}), nums AS (SELECT series_id, ds, y, row_number() OVER {W} AS rn FROM f)
SELECT n.series_id, n.ds, string_agg(concat(CAST(k.lag AS STRING), ':', coalesce(CAST(CAST(p.y AS BIGINT) AS STRING), '-')), ' ' ORDER BY k.lag) AS lag_values
FROM nums n JOIN (SELECT series_id, unnest(lags) AS lag FROM sig) k ON k.series_id = n.series_id LEFT JOIN nums p ON p.series_id = n.series_id AND p.rn = n.rn - k.lag GROUP BY 1, 2""")
def f10(spark: SparkSession, sf: str) -> DataFrame:
    series = filled(spark, sf)
    made = X.dynamic_lags(series, X.significant_lags(X.autocorrelations(series)))
    pairs = F.transform(F.array_sort(F.map_entries("lag_values")), lambda e: F.concat_ws(
        ":", e["key"].cast("string"), F.coalesce(e["value"].cast("bigint").cast("string"), F.lit("-"))))
    return made.select("series_id", "ds", F.concat_ws(" ", pairs).alias("lag_values"))


@query("f11_smart_momentum", FILLED_CTES + f"SELECT series_id, ds, CASE WHEN isodow(ds) = 1 THEN lag(y, 3) OVER {W} ELSE lag(y, 1) OVER {W} END AS smart_momentum FROM f")
def f11(spark: SparkSession, sf: str) -> DataFrame:
    return X.smart_momentum(filled(spark, sf)).drop("y")


_RATIO = {"trend_strength": f"lag(y, 7) OVER {W} / (roll_mean_7 + 1e-6)", "volatility_ratio": "roll_std_7 / (roll_std_28 + 1e-6)", "spike_ratio": f"lag(y, 1) OVER {W} / (roll_max_28 + 1e-6)"}


@query("f12_ratios", STRICT_CTES.rstrip() + ", r AS (SELECT series_id, ds, roll_mean_7, roll_max_28, " + ", ".join(f"{e} AS {n}" for n, e in _RATIO.items()) + """ FROM s)
SELECT series_id, ds, """ + ", ".join(f"CASE WHEN abs({n}) > 100 THEN round(log10(abs({n})), 4) ELSE round({n}, 4) END AS {n}" for n in _RATIO) + " FROM r")
def f12(spark: SparkSession, sf: str) -> DataFrame:
    """Every row; ratios over a vanishing statistic are huge and are compared by their magnitude."""
    made = X.ratios(X.strict_rolling_stats(filled(spark, sf)))
    return made.select("series_id", "ds", *[
        F.when(F.abs(n) > 100, F.round(F.log10(F.abs(n)), 4)).otherwise(F.round(n, 4)).alias(n) for n in _RATIO])


@query("f13_univariate_frame", FILLED_CTES.rstrip() + ", r AS (SELECT series_id, ds, " + ", ".join(f"lag(y, {k}) OVER {W} AS lag_{k}" for k in X.LAGS) + f", {_stat('avg', 28)} AS roll_mean_28 FROM f)\nSELECT series_id, ds, "
       + ", ".join(f"{_ffill(f'lag_{k}')} AS lag_{k}" for k in X.LAGS) + f", round({_ffill('roll_mean_28')}, 4) AS roll_mean_28, CAST(day(ds) AS INT) AS dom FROM r")
def f13(spark: SparkSession, sf: str) -> DataFrame:
    made = X.univariate_features(filled(spark, sf))
    return made.select("series_id", "ds", *[f"lag_{k}" for k in X.LAGS], F.round("roll_mean_28", 4).alias("roll_mean_28"), "dom")


@query("f13b_multivariate_frame", STRICT_CTES + f"""SELECT series_id, CAST(COUNT(*) AS BIGINT) AS n, MIN(ds) AS first_day, round(SUM(roll_mean_28), 2) AS means, CAST(SUM(roll_max_3) AS BIGINT) AS tops FROM (
  SELECT *, lag(y, 7) OVER {W} AS l7, row_number() OVER {W} AS rn FROM s) t WHERE rn > 28 GROUP BY 1""")
def f13b(spark: SparkSession, sf: str) -> DataFrame:
    return X.multivariate_features(filled(spark, sf)).groupBy("series_id").agg(
        F.count("*").alias("n"), F.min("ds").alias("first_day"), F.round(F.sum("roll_mean_28"), 2).alias("means"), F.sum("roll_max_3").cast("bigint").alias("tops"))


@query("f14_log_switch", VIEW_CTES + f"""SELECT series_id, round({SKEW}, 6) AS skew, coalesce(abs({SKEW}) > 2, false) AS use_log,
  round(SUM(CASE WHEN k.big THEN ln(1 + y) ELSE y END), 2) AS target_total FROM (SELECT series_id, ds, greatest(y, 0) AS y FROM treated) v JOIN (SELECT series_id, coalesce(abs({SKEW}) > 2, false) AS big FROM treated GROUP BY 1) k USING (series_id) GROUP BY 1""")
def f14(spark: SparkSession, sf: str) -> DataFrame:
    series = treated(spark, sf)
    switch = X.log_switch(series)
    total = series.join(switch, "series_id").groupBy("series_id").agg(F.round(F.sum(X.to_target(F.col("y"), F.col("use_log"))), 2).alias("target_total"))
    return switch.withColumn("skew", F.round("skew", 6)).join(total, "series_id")


@query("f15_decomposition", FILLED_CTES.rstrip() + f""", t AS (SELECT series_id, ds, y, (row_number() OVER {W} - 1) % 7 AS phase,
    CASE WHEN count(y) OVER c = 7 THEN avg(y) OVER c END AS trend FROM f WINDOW c AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  p AS (SELECT series_id, phase, avg(y - trend) AS m FROM t GROUP BY 1, 2), z AS (SELECT series_id, avg(m) AS c FROM p GROUP BY 1)
SELECT t.series_id, ds, round(trend, 4) AS trend, CAST(t.phase AS INT) AS phase, round(m - c, 4) AS seasonal, round(y - trend - (m - c), 4) AS residual FROM t JOIN p ON p.series_id = t.series_id AND p.phase = t.phase JOIN z ON z.series_id = t.series_id""")
def f15(spark: SparkSession, sf: str) -> DataFrame:
    return X.decompose(filled(spark, sf)).select("series_id", "ds", F.round("trend", 4).alias("trend"), "phase", F.round("seasonal", 4).alias("seasonal"), F.round("residual", 4).alias("residual"))


def _training(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    _, _, cleaned = views(spark, sf)
    train = cleaned.where("part = 'train'").select("series_id", "ds", "y")
    scale = PO.scales(train)
    return train, scale, PO.training_frame(train, scale)


@query("f16_feature_screening")
def f16(spark: SparkSession, sf: str) -> DataFrame:
    frame = materialize(_training(spark, sf)[2])
    return PO.screen_features(frame).select("feature", F.round("importance", 4).alias("importance"), F.round("mi", 4).alias("mi"), "kept")


# ---- closed-form models --------------------------------------------------------
HORIZON = 60
FITS = """SELECT series_id, unnest(CASE part WHEN 'train' THEN ['test', 'future'] ELSE ['future'] END) AS kind, ds, y FROM views WHERE part <> 'full'"""
TARGETS = f"""SELECT series_id, 'test' AS kind, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS step, ds FROM parts WHERE part = 'test' UNION ALL
  SELECT m.series_id, 'future', g.step, CAST(CASE q.freq WHEN 'W' THEN last_ds + CAST(7 * g.step AS INT) WHEN 'MS' THEN date_trunc('month', last_ds) + to_months(CAST(g.step AS INT)) ELSE last_ds + CAST(g.step AS INT) END AS DATE)
  FROM (SELECT series_id, MAX(ds) AS last_ds, least({HORIZON}, greatest(14, CAST(floor(0.3 * COUNT(*)) AS INT))) AS h FROM treated GROUP BY 1) m JOIN (SELECT series_id, {FREQ} AS freq FROM gaps) q ON q.series_id = m.series_id,
    LATERAL (SELECT unnest(generate_series(1, h)) AS step) g"""
MODEL_CTES = VIEW_CTES.rstrip() + f", gaps AS ({GAPS.format(src='treated')}), fits AS ({FITS}), targets AS ({TARGETS}), n AS (SELECT *, row_number() OVER (PARTITION BY series_id, kind ORDER BY ds) AS t, COUNT(*) OVER (PARTITION BY series_id, kind) AS n FROM fits)\n"
OUT = "SELECT t.series_id, t.kind, CAST(t.step AS INT) AS step, t.ds, round(greatest({value}, 0.0), 4) AS yhat FROM targets t JOIN m ON m.series_id = t.series_id AND m.kind = t.kind"


def setup(spark: SparkSession, sf: str, horizon: int = HORIZON) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cleaned views, fitting rows, targets) of the treated supplier series. The layout by series ends where views are
    filled, so the fitting rows are dealt anew into as many tasks: their number follows the input."""
    series, cutoff, cleaned = views(spark, sf)
    rows = cleaned.repartition(reading_tasks(spark, sf), "series_id")
    return cleaned, G.fit_rows(rows), G.targets(series, cutoff, horizon)


def _shown(predictions: DataFrame) -> DataFrame:
    return predictions.select("series_id", "kind", "step", "ds", F.round("yhat", 4).alias("yhat"))


SMA = """SELECT series_id, kind, avg(y) AS level FROM (SELECT series_id, kind, y, row_number() OVER (PARTITION BY series_id, kind ORDER BY ds DESC) AS rn, COUNT(*) OVER (PARTITION BY series_id, kind) AS n FROM (
    SELECT series_id, CASE part WHEN 'train' THEN 'test' ELSE 'future' END AS kind, ds, y FROM views WHERE part <> 'test')) WHERE rn <= greatest(7, least(28, n // 4)) GROUP BY 1, 2"""


@query("g01_moving_average", MODEL_CTES.rstrip() + f", m AS ({SMA})\n" + OUT.format(value="m.level"))
def g01(spark: SparkSession, sf: str) -> DataFrame:
    cleaned, _, wanted = setup(spark, sf)
    return _shown(G.predict_sma(cleaned, wanted))


@query("g02_sparse_fallback", MODEL_CTES.rstrip() + f", m AS ({SMA})\n" + """
SELECT series_id, kind, round(level, 4) AS level, sparse FROM m JOIN (SELECT series_id, COUNT(*) < 90 OR (AVG(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END) > 0.7 AND AVG(y) < 5) AS sparse FROM views WHERE part = 'train' GROUP BY 1) s USING (series_id)""")
def g02(spark: SparkSession, sf: str) -> DataFrame:
    """The fallback level of every series, and whether the series is sparse enough to get it."""
    from seriesloom.operators.demand import train_stats
    cleaned, _, _ = setup(spark, sf)
    stats = train_stats(cleaned.where("part = 'train'"))
    sparse = (F.col("n_points") < 90) | ((F.col("zero_ratio") > 0.7) & (F.col("mean_val") < 5))
    return G.fit_sma(G.baseline_rows(cleaned)).join(stats.select("series_id", sparse.alias("sparse")), "series_id").withColumn("level", F.round("level", 4))


LINE = "SELECT series_id, kind, MAX(n) AS n, regr_slope(y, t) AS slope, regr_intercept(y, t) AS intercept FROM n GROUP BY 1, 2"


@query("g03_linear_trend", MODEL_CTES.rstrip() + f", m AS ({LINE})\n" + OUT.format(value="intercept + slope * (n + t.step)"))
def g03(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    return _shown(G.predict_linear(rows, wanted))


CROSTON = """SELECT a.series_id, a.kind, coalesce(greatest(0.0, size / greatest(CASE WHEN gaps > 0 THEN p ELSE 1.0 END, 1.0)), 0.0) AS level FROM (SELECT DISTINCT series_id, kind FROM fits) a LEFT JOIN (
    SELECT series_id, kind, list_reduce(list(y ORDER BY t), lambda s, d: 0.1 * d + 0.9 * s) AS size, COUNT(gap) AS gaps,
      list_reduce(list_concat([avg(gap)], list_slice(list(gap ORDER BY t) FILTER (WHERE gap IS NOT NULL), 2, 100000)), lambda s, d: 0.1 * d + 0.9 * s) AS p FROM (
      SELECT *, CAST(t - lag(t) OVER (PARTITION BY series_id, kind ORDER BY t) AS DOUBLE) AS gap FROM n WHERE y > 0) GROUP BY 1, 2) f ON f.series_id = a.series_id AND f.kind = a.kind"""


@query("g04_croston", MODEL_CTES.rstrip() + f", m AS ({CROSTON})\n" + OUT.format(value="m.level"))
def g04(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    return _shown(G.predict_croston(rows, wanted))


SES = """SELECT series_id, kind, arg_min(level, (sse, alpha)) AS level, arg_min(alpha, (sse, alpha)) AS alpha FROM (
    SELECT series_id, kind, alpha, struct_extract(r, 'l') AS level, struct_extract(r, 's') AS sse FROM (
      SELECT series_id, kind, a.alpha, list_reduce(list_transform(ys, lambda v: {'l': v, 's': CAST(0.0 AS DOUBLE)}),
        lambda x, v: {'l': a.alpha * v.l + (1 - a.alpha) * x.l, 's': x.s + (v.l - x.l) * (v.l - x.l)}) AS r
      FROM (SELECT series_id, kind, list(y ORDER BY ds) AS ys FROM fits GROUP BY 1, 2) q, (SELECT CAST(unnest(generate_series(1, 19)) AS DOUBLE) / 20 AS alpha) a) z) y GROUP BY 1, 2"""


@query("g05_simple_smoothing", MODEL_CTES.rstrip() + f", ses AS ({SES})\nSELECT series_id, kind, round(level, 4) AS level, round(alpha, 2) AS alpha FROM ses")
def g05(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, _ = setup(spark, sf)
    return S.fit_ses(rows).select("series_id", "kind", F.round("level", 4).alias("level"), F.round("alpha", 2).alias("alpha"))


@query("g06_theta", MODEL_CTES.rstrip() + f", ses AS ({SES}), m AS (SELECT l.*, ses.level FROM ({LINE}) l JOIN ses ON ses.series_id = l.series_id AND ses.kind = l.kind)\n" + OUT.format(value="(intercept + slope * (n + t.step) + level) / 2"))
def g06(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    return _shown(S.predict_theta(rows, wanted))


# ---- numeric and pooled models -------------------------------------------------
@query("g07_holt_winters")
def g07(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    return _shown(S.paths_to_predictions(S.fit_holt_winters(rows, wanted), wanted))


@query("g08_harmonic_regression")
def g08(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    wanted = S.days_ahead(rows, wanted)
    return _shown(S.paths_to_predictions(S.fit_harmonic(rows, wanted), wanted))


@query("g08b_changepoint_trend", MODEL_CTES + "SELECT series_id, kind, CAST(COUNT(*) AS BIGINT) AS n, COUNT(DISTINCT ds) > 1 AS fitted, 0.0 AS violation FROM fits GROUP BY 1, 2")
def g08b(spark: SparkSession, sf: str) -> DataFrame:
    """Every fit with its distance from the conditions of an optimum, which are worked out from the rows."""
    _, rows, _ = pooled_setup(spark, sf)
    fitted = materialize(CP.fit_changepoints(rows))
    found = CP.optimality(rows, fitted)
    return fitted.select("series_id", "kind", "n", F.col("error").isNull().alias("fitted")).join(found.drop("n"), ["series_id", "kind"], "left").select(
        "series_id", "kind", "n", "fitted", F.round(F.coalesce("violation", F.lit(0.0)), 6).alias("violation"))


@query("g08c_changepoint_forecast")
def g08c(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    return _shown(CP.predict_changepoints(CP.fit_changepoints(rows), wanted))


@query("g09_differenced_ar")
def g09(spark: SparkSession, sf: str) -> DataFrame:
    _, rows, wanted = setup(spark, sf)
    return _shown(S.paths_to_predictions(S.fit_differenced_ar(rows, wanted), wanted))


def pooled_setup(spark: SparkSession, sf: str, horizon: int = HORIZON, dealt: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``setup``, with the cleaned views written once, for training reads them often, and where ``dealt`` spread by
    series over tasks whose number follows the input. Bin edges of trees come from sketches, whose digits follow the layout."""
    cleaned, _, wanted = setup(spark, sf, horizon)
    cleaned = materialize(cleaned)
    if dealt:
        cleaned = cleaned.repartition(reading_tasks(spark, sf), "series_id")
    return cleaned, G.fit_rows(cleaned), wanted


def _pooled(name: str, model: str, **settings: float) -> None:
    @query(name)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        cleaned, rows, wanted = pooled_setup(spark, sf, dealt=model not in ("LightGBM", "ExtraTrees"))
        predictions, _ = PO.fit_pooled(model, cleaned, rows, wanted, **settings)
        return _shown(predictions)


_pooled("g10_pooled_boosting", "LightGBM")
_pooled("g11_pooled_forest", "ExtraTrees")
_pooled("g12_pooled_ridge", "Ridge")
_pooled("g13_pooled_huber", "Huber")


@query("g14_recursive_forecast")
def g14(spark: SparkSession, sf: str) -> DataFrame:
    cleaned, rows, wanted = pooled_setup(spark, sf)
    predictions, _ = PO.fit_pooled("Ridge", cleaned, rows, wanted)
    return _shown(predictions)


# Fixed weights, so that SQL can roll the same line: scaled by nothing, one step feeding the next.
LINE_WEIGHTS = {"lag_1": 0.5, "lag_7": 0.3, "roll_mean_7": 0.1, "dow": 0.25, "month_cos": -0.5}
LINE_START = 1.5


@query("g14b_recursion_of_a_given_line", FILLED_CTES.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", b AS (SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM f),
  s AS (SELECT series_id, MAX(ds) AS last_ds, list(y ORDER BY ds) AS st FROM b WHERE back <= 28 GROUP BY 1),
  rolled AS (SELECT series_id, last_ds, 0 AS step, st FROM s UNION ALL
    SELECT series_id, last_ds, step + 1, list_append(st[-27:], greatest(0.0, {LINE_START} + 0.5 * st[-1] + 0.3 * st[-7] + 0.1 * list_avg(st[-7:]) + 0.25 * (isodow(last_ds + step + 1) - 1)
      - 0.5 * cos(2 * pi() * month(last_ds + step + 1) / 12))) FROM rolled WHERE step < {HORIZON})
SELECT series_id, 'future' AS kind, step, CAST(last_ds + step AS DATE) AS ds, round(st[-1], 4) AS yhat FROM rolled WHERE step > 0""")
def g14b(spark: SparkSession, sf: str) -> DataFrame:
    """The one-pass recursion of a model whose weights are given."""
    rows = filled(spark, sf).withColumn("kind", F.lit("future"))
    line = PO.Fitted("line", PO.FEATURES, weights=np.array([LINE_WEIGHTS.get(f, 0.0) for f in PO.FEATURES]), intercept=LINE_START)
    states = PO.start_states(rows, rows.select("series_id").distinct().withColumn("scale", F.lit(1.0)))
    wanted = states.select("series_id", "kind", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("step"), "last_ds").select(
        "series_id", "kind", "step", F.date_add("last_ds", F.col("step")).alias("ds"))
    days = PO.known_days(X.cyclical(X.calendar(wanted)), PO.CALENDAR_FEATURES)
    return _shown(PO.path_predictions(PO.rolled_paths(line, states, days, PO.CALENDAR_FEATURES), wanted, "line"))


_LAST28 = "SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM f"


@query("g15_future_row", FILLED_CTES.rstrip() + f", b AS ({_LAST28})\nSELECT series_id, " + ", ".join(f"round(MAX(CASE WHEN back = {k} THEN y END), 4) AS lag_{k}" for k in X.LAGS)
       + ", " + ", ".join(f"round(AVG(CASE WHEN back <= {k} THEN y END), 4) AS roll_mean_{k}" for k in (7, 14, 28))
       + ", MAX(CASE WHEN back <= 7 THEN y END) AS roll_max_7, round(stddev_samp(CASE WHEN back <= 7 THEN y END), 4) AS roll_std_7, CAST(isodow(MAX(ds) + 1) - 1 AS DOUBLE) AS dow, CAST(month(MAX(ds) + 1) AS DOUBLE) AS month, CAST(dayofyear(MAX(ds) + 1) AS DOUBLE) AS doy, round(cos(2 * pi() * month(MAX(ds) + 1) / 12), 6) AS month_cos FROM b GROUP BY 1")
def g15(spark: SparkSession, sf: str) -> DataFrame:
    series = filled(spark, sf)
    states = PO.start_states(series.withColumn("kind", F.lit("future")), series.groupBy("series_id").agg(F.lit(1.0).alias("scale")))
    rows = states.select("series_id", *PO.future_row(F.col("state"), F.date_add("last_ds", 1)))
    return rows.select("series_id", *[F.round(f"lag_{k}", 4).alias(f"lag_{k}") for k in X.LAGS], *[F.round(f"roll_mean_{k}", 4).alias(f"roll_mean_{k}") for k in (7, 14, 28)],
                       "roll_max_7", F.round("roll_std_7", 4).alias("roll_std_7"), "dow", "month", "doy", F.round("month_cos", 6).alias("month_cos"))


@query("g16_ensemble_blend", ctes("scored_pairs", p="SELECT series_id, model, ds, actual, CASE model WHEN 'ByPrice' THEN 0.3 * predicted + 0.7 * actual ELSE predicted END AS predicted FROM scored_pairs", s="""
  SELECT series_id, model, SUM(abs(actual - predicted)) / (SUM(abs(actual)) + 1e-8) AS w FROM p GROUP BY 1, 2""", r="""
  SELECT series_id, string_agg(model, '+' ORDER BY w, model) AS names, MIN(w) AS best, MAX(w) AS second, SUM(1 / (w + 1e-8)) AS inv FROM s GROUP BY 1""", m="""
  SELECT p.series_id, concat('Ensemble[', names, ']') AS model, best, ds, MAX(actual) AS actual, SUM(predicted * (1 / (w + 1e-8)) / inv) AS predicted FROM p JOIN s USING (series_id, model) JOIN r ON r.series_id = p.series_id
  WHERE best >= 1e-6 AND (second - best) / (best + 1e-8) <= 0.2 GROUP BY 1, 2, 3, 4""") + """
SELECT series_id, model, ds, round(actual, 4) AS actual, round(predicted, 4) AS predicted FROM m WHERE series_id IN (SELECT series_id FROM m GROUP BY series_id HAVING SUM(abs(actual - predicted)) / (SUM(abs(actual)) + 1e-8) < MAX(best))""")
def g16(spark: SparkSession, sf: str) -> DataFrame:
    close = F.when(F.col("model") == "ByPrice", 0.3 * F.col("predicted") + 0.7 * F.col("actual")).otherwise(F.col("predicted"))
    pairs = load(spark, sf, "scored_pairs").withColumn("predicted", close)
    scores = pairs.groupBy("series_id", "model").agg(M.wmape().alias("wmape"))
    return PO.blend(pairs, scores).select("series_id", "model", "ds", F.round("actual", 4).alias("actual"), F.round("predicted", 4).alias("predicted"))


@query("g17_align_predictions", VIEW_CTES.rstrip() + """, a AS (SELECT series_id, ds FROM parts WHERE part = 'test'), p AS (SELECT series_id, ds, y * 2 AS yhat FROM parts WHERE part = 'test' AND day(ds) % 3 = 0)
SELECT a.series_id, 'Twice' AS model, a.ds, round(coalesce(last_value(p.yhat IGNORE NULLS) OVER (PARTITION BY a.series_id ORDER BY a.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 4) AS yhat
FROM a LEFT JOIN p ON p.series_id = a.series_id AND p.ds = a.ds WHERE a.series_id IN (SELECT series_id FROM p)""")
def g17(spark: SparkSession, sf: str) -> DataFrame:
    series = treated(spark, sf)
    test = P.split_parts(series, P.split_cutoff(series, TEST_WINDOW)).where("part = 'test'").withColumn("kind", F.lit("test"))
    some = test.where(F.dayofmonth("ds") % 3 == 0).select("series_id", F.lit("Twice").alias("model"), "kind", "ds", (F.col("y") * 2).alias("yhat"))
    return G.align_predictions(some, test.select("series_id", "kind", "ds")).withColumn("yhat", F.round("yhat", 4))


@query("g18_feature_importance")
def g18(spark: SparkSession, sf: str) -> DataFrame:
    frame = materialize(_training(spark, sf)[2])
    forest, ridge = (PO.fit_model(name, frame, PO.FEATURES) for name in ("ExtraTrees", "Ridge"))
    return PO.feature_importance(forest, "ExtraTrees", frame).unionByName(PO.feature_importance(ridge, "Ridge", frame))
