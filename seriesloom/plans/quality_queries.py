"""Queries for the quality report, demand profile, metrics and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.operators import demand as D, metrics as M, prepare as P, quality as Q, select as S
from seriesloom.plans.inputs import ctes, load
from seriesloom.plans.prepare_queries import (
    BOUNDS, GRID, SKEW, VIEW_CTES, FREQ, GAPS, TREATED_SQL, treated, views,
)
from seriesloom.plans.registry import ORACLES, query

HORIZON, TEST_WINDOW = 365, 30

# ---- quality report ------------------------------------------------------------
TYPED = """SELECT series_id, row_no, try_cast(ds_raw AS TIMESTAMP) AS ds, y_raw, try_cast(y_raw AS DOUBLE) AS y FROM raw_readings"""
LAST = """SELECT series_id, ds, y, copies - 1 AS duplicates FROM (
    SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id, ds ORDER BY row_no DESC, y DESC NULLS LAST) AS rn,
      COUNT(*) OVER (PARTITION BY series_id, ds) AS copies FROM typed WHERE ds IS NOT NULL) WHERE rn = 1"""
COUNTS = """SELECT series_id, COUNT(*) AS rows_total, COUNT(*) - COUNT(ds) AS unparseable_dates,
    COUNT(CASE WHEN ds IS NOT NULL AND y_raw IS NOT NULL AND y IS NULL THEN 1 END) AS non_numeric_values FROM typed GROUP BY 1"""
SHAPE = f"""SELECT series_id, COUNT(*) AS n, COUNT(y) AS usable, SUM(duplicates) AS duplicates, MIN(ds) AS start_ts, MAX(ds) AS end_ts,
    CAST(floor(date_diff('microsecond', MIN(ds), MAX(ds)) / 86400000000.0) AS INT) AS span_days, COUNT(CASE WHEN y < 0 THEN 1 END) AS negatives,
    COUNT(CASE WHEN y = 0 THEN 1 END) AS zeros, {SKEW} AS skew, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM last GROUP BY 1"""
KEPT = """SELECT l.series_id, COUNT(CASE WHEN date_diff('microsecond', s.start_ts, l.ds) % 86400000000 = 0 THEN l.y END) AS kept,
    MAX(s.span_days) + 1 AS grid_days, COUNT(CASE WHEN q3 > q1 AND l.y > q3 + 3 * (q3 - q1) THEN 1 END) AS outliers FROM last l JOIN shape s USING (series_id) GROUP BY 1"""
SCOREABLE = f"""SELECT series_id, COUNT(CASE WHEN y <> 0 THEN 1 END) AS scoreable FROM (
    SELECT l.series_id, l.y, row_number() OVER (PARTITION BY l.series_id ORDER BY ds DESC) AS rn, greatest(7, least({TEST_WINDOW}, CAST(floor(0.2 * n) AS INT))) AS split
    FROM last l JOIN shape USING (series_id)) WHERE rn <= split GROUP BY 1"""
PROFILE = f"""SELECT c.series_id, c.rows_total, coalesce(usable, 0) AS usable, start_ts, end_ts, span_days, unparseable_dates, non_numeric_values,
    coalesce(duplicates, 0) AS duplicates, coalesce(usable, 0) >= 30 AS ready, 1 - kept / grid_days AS imputed_share, kept, med, {FREQ} AS freq,
    CASE WHEN usable >= 30 THEN negatives ELSE 0 END AS negatives, CASE WHEN usable >= 30 THEN zeros / usable ELSE 0.0 END AS zero_share,
    CASE WHEN usable >= 30 THEN outliers ELSE 0 END AS outliers, skew, CASE WHEN q3 > q1 THEN q3 + 3 * (q3 - q1) END AS upper, scoreable,
    CASE WHEN usable >= 30 THEN greatest(7, least({TEST_WINDOW}, CAST(floor(0.2 * n) AS INT))) ELSE 0 END AS split,
    CASE WHEN usable >= 30 THEN least({HORIZON}, greatest(14, CAST(floor(0.3 * n) AS INT))) ELSE 0 END AS horizon
  FROM counts c LEFT JOIN shape s ON s.series_id = c.series_id LEFT JOIN kept k ON k.series_id = c.series_id
  LEFT JOIN scoreable o ON o.series_id = c.series_id LEFT JOIN gaps g ON g.series_id = c.series_id"""
PROFILE_CTES = ctes("raw_readings", typed=TYPED, last=LAST, counts=COUNTS, shape=SHAPE, kept=KEPT, scoreable=SCOREABLE,
                    gaps=GAPS.format(src="last"), profile=PROFILE)


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    return Q.series_profile(load(spark, sf, "raw_readings"), HORIZON, TEST_WINDOW)


@query("d01_series_profile", PROFILE_CTES + """
SELECT series_id, rows_total, CAST(usable AS BIGINT) AS usable_points, strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS "start", strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS "end",
  span_days, CASE WHEN ready THEN freq END AS inferred_frequency, CASE WHEN ready THEN round(imputed_share, 4) END AS imputed_pct,
  CAST(duplicates AS BIGINT) AS duplicate_timestamps, CAST(unparseable_dates AS BIGINT) AS unparseable_dates, CAST(non_numeric_values AS BIGINT) AS non_numeric_values,
  CAST(negatives AS BIGINT) AS negative_values, round(zero_share, 4) AS zero_pct, CAST(outliers AS BIGINT) AS outliers, split AS test_split_size, horizon AS effective_horizon FROM profile""")
def d01(spark: SparkSession, sf: str) -> DataFrame:
    return _profile_rows(_profile(spark, sf))


def _profile_rows(profile: DataFrame) -> DataFrame:
    stamp = "yyyy-MM-dd HH:mm:ss"
    return profile.select(
        "series_id", "rows_total", "usable_points", F.date_format("start", stamp).alias("start"), F.date_format("end", stamp).alias("end"),
        "span_days", "inferred_frequency", F.round("imputed_share", 4).alias("imputed_pct"), "duplicate_timestamps", "unparseable_dates",
        "non_numeric_values", "negative_values", "zero_pct", "outliers", "test_split_size", "effective_horizon")


@query("d01b_profile_of_dense_series", ORACLES["d01_series_profile"])
def d01b(spark: SparkSession, sf: str) -> DataFrame:
    """The same report from readings dealt anew over many partitions."""
    readings = load(spark, sf, "raw_readings").repartition(64)
    return _profile_rows(Q.series_profile(readings, HORIZON, TEST_WINDOW))


def _plural(n: str, word: str) -> str:
    return f"concat(format('{{:,}}', {n}), ' {word}', CASE WHEN {n} = 1 THEN '' ELSE 's' END)"


PCT = "concat(CAST(CAST(round_even(imputed_share * 100, 0) AS INT) AS STRING), '%')"
MONEY = "format('{:,.2f}', upper)"
NEEDED = "greatest(7, CAST(floor(0.3 * split) AS INT))"
# Codes and message texts. Per code: condition, message, severity.
ISSUES = {
    "d02_insufficient_history": ("insufficient_history", "NOT ready", f"concat('Only ', {_plural('usable', 'usable data point')}, '; at least 30 are needed to train and test a model.')", "blocking"),
    "d03_unparseable_dates": ("unparseable_dates", "unparseable_dates > 0", f"concat({_plural('unparseable_dates', 'row')}, ' with a missing or unreadable date will be dropped.')", "warning"),
    "d04_non_numeric_values": ("non_numeric_values", "non_numeric_values > 0", f"concat({_plural('non_numeric_values', 'value')}, ' aren''t numbers and will be treated as missing.')", "warning"),
    "d05_duplicate_timestamps": ("duplicate_timestamps", "duplicates > 0", f"concat({_plural('CAST(duplicates AS BIGINT)', 'duplicate date')}, ': only the last value for each date is kept — values are not summed.')", "warning"),
    "d06_coarser_than_daily": ("non_daily_frequency", "ready AND med > 1", f"concat('Data is spaced about every ', CAST(CAST(floor(med) AS BIGINT) AS STRING), ' days, but the pipeline works on daily data — ', {PCT}, ' of the daily points it trains on will be filled in, not observed.')", "warning"),
    "d07_finer_than_daily": ("non_daily_frequency", "ready AND med < 1", f"concat('Data is recorded more often than daily, but the pipeline keeps one reading per day — ', {_plural('(usable - kept)', 'data point')}, ' of ', format('{{:,}}', usable), ' will be ignored.')", "warning"),
    "d08_date_gaps": ("date_gaps", "ready AND med = 1 AND imputed_share > 0.10", f"concat({PCT}, ' of the days between ', strftime(start_ts, '%Y-%m-%d'), ' and ', strftime(end_ts, '%Y-%m-%d'), ' have no value and will be filled in by the pipeline.')", "warning"),
    "d09_negative_values": ("negative_values", "negatives > 0", f"concat({_plural('negatives', 'negative value')}, ' will be clipped to 0.')", "warning"),
    "d10_outliers": ("outliers", "outliers > 0", f"concat({_plural('outliers', 'unusually high value')}, ' (above ', {MONEY}, '); ', CASE WHEN abs(skew) > 2 THEN concat('they will be clipped to ', {MONEY}) ELSE 'they will be left as-is, and may pull the forecast' END, '.')", "warning"),
    "d11_horizon_capped": ("horizon_capped", f"ready AND {HORIZON} > horizon", f"concat('The {HORIZON}-day horizon will be shortened to ', CAST(horizon AS STRING), ' days — the pipeline caps it at 30% of the available history.')", "warning"),
    "d12_sparse_test_window": ("sparse_test_window", f"ready AND scoreable < {NEEDED}", f"concat('Only ', {_plural('scoreable', 'non-zero value')}, ' in the last ', CAST(split AS STRING), ' points used for testing; models need ', CAST({NEEDED} AS STRING), ' to be scored, so most will be skipped and the run may fall back to a simple moving average.')", "warning"),
    "d13_short_history": ("short_history", "ready AND span_days <= 90", "concat('Only ', CAST(span_days AS STRING), ' days of history — too short for seasonal patterns, so the forecast will mostly follow recent levels.')", "warning"),
}


def _issue_sql(name: str) -> str:
    code, when, message, severity = ISSUES[name]
    return f"SELECT series_id, '{code}' AS code, '{severity}' AS severity, {message} AS message FROM profile WHERE {when}"


def _issue_query(name: str) -> None:
    code = ISSUES[name][0]
    finer = {"d06_coarser_than_daily": "Data is spaced", "d07_finer_than_daily": "Data is recorded"}.get(name, "")

    @query(name, PROFILE_CTES + _issue_sql(name))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = Q.issue_rows(Q.quality_report(load(spark, sf, "raw_readings"), HORIZON, TEST_WINDOW))
        return rows.where((F.col("code") == code) & F.col("message").startswith(finer)).drop("issue_no")


for _name in ISSUES:
    _issue_query(_name)

_ASKED = "SELECT DISTINCT concat('lineitem/S', CAST(o_custkey AS STRING)) AS series_id FROM orders"
_GENERAL = "SELECT a.series_id AS label FROM asked a LEFT JOIN (SELECT DISTINCT series_id FROM raw_readings) r ON r.series_id = a.series_id WHERE r.series_id IS NULL"


def _general(spark: SparkSession, sf: str) -> DataFrame:
    """Selected series the data does not hold, as report-level warnings."""
    from seriesloom.plans.inputs import table
    asked = table(spark, sf, "orders").select(F.concat(F.lit("lineitem/S"), F.col("o_custkey").cast("string")).alias("series_id")).distinct()
    missing = asked.join(load(spark, sf, "raw_readings").select("series_id").distinct(), "series_id", "left_anti")
    return missing.select(F.lit("metric_missing_in_sheet").alias("code"), F.lit("warning").alias("severity"), F.col("series_id").alias("message"))


@query("d14_metric_missing", ctes("raw_readings", asked=_ASKED, general=_GENERAL) + """
SELECT 'metric_missing_in_sheet' AS code, 'warning' AS severity, label AS message FROM general""")
def d14(spark: SparkSession, sf: str) -> DataFrame:
    return _general(spark, sf)


_BLOCKED = "(SELECT bool_or(NOT ready) FROM profile)"


@query("d15_report_gate", PROFILE_CTES.rstrip() + f", asked AS ({_ASKED}), general AS ({_GENERAL})\n" + f"""
SELECT (SELECT CAST(COUNT(*) AS BIGINT) FROM profile) AS n_series, (SELECT CAST(COUNT(*) AS BIGINT) FROM general) AS n_general, {_BLOCKED} AS has_blocking""")
def d15(spark: SparkSession, sf: str) -> DataFrame:
    return Q.report_gate(Q.quality_report(load(spark, sf, "raw_readings"), HORIZON, TEST_WINDOW), _general(spark, sf))


@query("d16_issue_groups", PROFILE_CTES.rstrip() + f", asked AS ({_ASKED}), general AS ({_GENERAL}), issues AS ("
       + " UNION ALL ".join(_issue_sql(n) for n in ISSUES) + """)
SELECT severity, 1 AS place, series_id AS label, CAST(COUNT(*) AS BIGINT) AS issues FROM issues GROUP BY 1, 2, 3
UNION ALL SELECT 'warning', 0, NULL, CAST(COUNT(*) AS BIGINT) FROM general HAVING COUNT(*) > 0""")
def d16(spark: SparkSession, sf: str) -> DataFrame:
    return Q.group_issues(Q.quality_report(load(spark, sf, "raw_readings"), HORIZON, TEST_WINDOW), _general(spark, sf))


# ---- demand --------------------------------------------------------------------
DEMAND = """SELECT series_id, COALESCE(y, 0.0) AS y FROM grid UNION ALL SELECT series_id, y FROM priority_daily
  UNION ALL SELECT concat(series_id, '/spiky'), y * y * CASE WHEN day(ds) = 1 THEN 400 ELSE 1 END FROM supplier_daily"""
ADI = """SELECT series_id, COUNT(*) AS periods, COUNT(CASE WHEN y > 0 THEN 1 END) AS demand_periods, COUNT(*) / nullif(COUNT(CASE WHEN y > 0 THEN 1 END), 0) AS adi,
    CASE WHEN COUNT(CASE WHEN y > 0 THEN 1 END) < 2 THEN 0.0 ELSE power(stddev_samp(CASE WHEN y > 0 THEN y END) / (AVG(CASE WHEN y > 0 THEN y END) + 1e-8), 2) END AS cv2
  FROM demand GROUP BY 1"""
KIND = "CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN adi < 1.32 THEN 'Erratic' WHEN cv2 < 0.49 THEN 'Intermittent' ELSE 'Lumpy' END"
DEMAND_CTES = ctes("supplier_daily", "priority_daily", bounds=BOUNDS, grid=GRID, demand=DEMAND, adi=ADI)


def demand_series(spark: SparkSession, sf: str) -> DataFrame:
    daily = load(spark, sf, "supplier_daily")
    grid = P.daily_grid(daily).select("series_id", F.coalesce("y", F.lit(0.0)).alias("y"))
    spiky = daily.select(F.concat("series_id", F.lit("/spiky")).alias("series_id"),
                         (F.col("y") * F.col("y") * F.when(F.dayofmonth("ds") == 1, 400).otherwise(1)).alias("y"))
    return grid.unionByName(load(spark, sf, "priority_daily").select("series_id", "y")).unionByName(spiky)


@query("e01_adi", DEMAND_CTES + "SELECT series_id, CAST(periods AS BIGINT) AS periods, CAST(demand_periods AS BIGINT) AS demand_periods, round(adi, 6) AS adi FROM adi")
def e01(spark: SparkSession, sf: str) -> DataFrame:
    return D.demand_profile(demand_series(spark, sf)).select("series_id", "periods", "demand_periods", F.round("adi", 6).alias("adi"))


@query("e02_cv2", DEMAND_CTES + "SELECT series_id, round(cv2, 6) AS cv2 FROM adi")
def e02(spark: SparkSession, sf: str) -> DataFrame:
    return D.demand_profile(demand_series(spark, sf)).select("series_id", F.round("cv2", 6).alias("cv2"))


@query("e03_quadrant", DEMAND_CTES + f"SELECT series_id, {KIND} AS demand_type, adi >= 1.32 AS is_intermittent, cv2 >= 0.49 AS is_erratic FROM adi")
def e03(spark: SparkSession, sf: str) -> DataFrame:
    return D.demand_profile(demand_series(spark, sf)).select("series_id", "demand_type", "is_intermittent", "is_erratic")


RECOMMENDED = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in D.RECOMMENDED_MODELS.items()) + " END"


@query("e04_recommended_models", DEMAND_CTES + f"SELECT series_id, {RECOMMENDED} AS models FROM (SELECT series_id, {KIND} AS kind FROM adi) k")
def e04(spark: SparkSession, sf: str) -> DataFrame:
    return D.recommend_models(D.demand_profile(demand_series(spark, sf))).select("series_id", F.concat_ws(",", "recommended_models").alias("models"))


_DIM = " UNION ALL ".join(
    f"SELECT '{kind}' AS kind, '{m}' AS model, {i + 1} AS rank"
    for kind, pref in D.RECOMMENDED_MODELS.items() for i, m in enumerate(pref + [m for m in D.ALL_MODELS if m not in pref]))


@query("e05_model_routing", DEMAND_CTES.rstrip() + f""", stats AS (SELECT series_id, COUNT(*) AS n_points, AVG(y) AS mean_val, COUNT(CASE WHEN y = 0 THEN 1 END) / COUNT(*) AS zero_ratio,
    stddev_samp(y) / (AVG(y) + 1e-6) AS cv FROM demand GROUP BY 1), dim AS ({_DIM}), k AS (SELECT series_id, {KIND} AS kind, adi >= 1.32 AS inter FROM adi)
SELECT k.series_id, kind AS demand_type, model, rank FROM k JOIN stats s ON s.series_id = k.series_id JOIN dim USING (kind)
WHERE NOT (n_points < 90 OR (zero_ratio > 0.7 AND mean_val < 5)) AND NOT (model IN ('Prophet', 'SARIMAX') AND mean_val < 10) AND NOT (model = 'Prophet' AND zero_ratio > 0.8)
  AND NOT (model = 'SARIMAX' AND cv > 1.5) AND NOT (model = 'Croston' AND NOT inter) AND NOT (model = 'LinearBaseline' AND kind = 'Smooth')""")
def e05(spark: SparkSession, sf: str) -> DataFrame:
    series = demand_series(spark, sf)
    return D.route_models(D.demand_profile(series), D.train_stats(series))


@query("e06_declared_catalog", DEMAND_CTES.rstrip() + f""", declared AS (
  SELECT concat('S', CAST(s_suppkey AS STRING)) AS series_id, CAST(2490 + s_suppkey % 5 AS BIGINT) AS declared_rows,
    CASE WHEN s_acctbal < 0 THEN 'Smooth' WHEN s_acctbal < 5000 THEN 'Intermittent' ELSE 'Lumpy' END AS declared_type FROM supplier)
SELECT d.series_id, declared_rows, declared_type, CAST(coalesce(periods, 0) AS BIGINT) AS actual_rows, k.kind AS actual_type,
  coalesce(periods = declared_rows, false) AND coalesce(k.kind = declared_type, false) AS matches
FROM declared d LEFT JOIN (SELECT series_id, periods, {KIND} AS kind FROM adi) k ON k.series_id = d.series_id""")
def e06(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.plans.inputs import table
    declared = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("series_id"),
        (F.lit(2490) + F.col("s_suppkey") % 5).cast("bigint").alias("declared_rows"),
        F.when(F.col("s_acctbal") < 0, "Smooth").when(F.col("s_acctbal") < 5000, "Intermittent").otherwise("Lumpy").alias("declared_type"))
    return D.check_declared(D.demand_profile(demand_series(spark, sf)), declared)


# ---- metrics -------------------------------------------------------------------
PAIR_CTES = ctes("scored_pairs")
KEY = ["series_id", "model"]
WMAPE = "SUM(abs(actual - predicted)) / (SUM(abs(actual)) + 1e-8)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "scored_pairs")


def _metric(name: str, sql: str, pick: str, digits: int = 6) -> None:
    @query(name, PAIR_CTES + f"SELECT series_id, model, round({sql}, {digits}) AS {pick} FROM scored_pairs GROUP BY 1, 2")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return M.score_pairs(_pairs(spark, sf), KEY).select(*KEY, F.round(pick, digits).alias(pick))


_metric("h01_wmape", WMAPE, "wmape")
_metric("h02_mae", "AVG(abs(actual - predicted))", "mae", 4)
_metric("h03_mape", "AVG(CASE WHEN abs(actual) > 1e-8 THEN abs((actual - predicted) / actual) END) * 100", "mape")
_metric("h04_rmse", "sqrt(AVG((actual - predicted) * (actual - predicted)))", "rmse", 4)
_metric("h05_accuracy", f"greatest(0.0, least(100.0, (1 - {WMAPE}) * 100))", "accuracy")

TREND = """SELECT series_id, model, CASE WHEN COUNT(*) < 2 THEN 0.0 ELSE abs(regr_slope(actual, x) - regr_slope(predicted, x)) / (AVG(abs(actual)) + 1e-8) END AS trend,
    stddev_samp(predicted) AS fc_std FROM (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY ds) - 1.0 AS x FROM scored_pairs) GROUP BY 1, 2"""
STDS = "SELECT series_id, stddev_samp(y) / 8 AS train_std FROM supplier_daily GROUP BY 1"
PENALTY = "CASE WHEN fc_std IS NULL THEN 0.0 WHEN fc_std / (train_std + 1e-8) <= 2.5 THEN 0.0 ELSE least(1.0, (fc_std / (train_std + 1e-8) - 2.5) / (fc_std / (train_std + 1e-8) - 1.5)) END"
SCORE_CTES = ctes("scored_pairs", "supplier_daily", trend=TREND, stds=STDS)


def _train_std(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "supplier_daily").groupBy("series_id").agg((F.stddev_samp("y") / 8).alias("train_std"))


@query("h06_trend_error", SCORE_CTES + "SELECT series_id, model, round(trend, 6) AS trend_error FROM trend")
def h06(spark: SparkSession, sf: str) -> DataFrame:
    return M.trend_error(_pairs(spark, sf), KEY).select(*KEY, F.round("trend_error", 6).alias("trend_error"))


@query("h07_variance_penalty", SCORE_CTES + f"SELECT series_id, model, round({PENALTY}, 6) AS variance_penalty FROM trend JOIN stds USING (series_id)")
def h07(spark: SparkSession, sf: str) -> DataFrame:
    return M.score_pairs(_pairs(spark, sf), KEY, _train_std(spark, sf)).select(*KEY, F.round("variance_penalty", 6).alias("variance_penalty"))


COMPOSITE = f"0.7 * wmape + 0.2 * trend + 0.1 * {PENALTY}"
W = f"SELECT series_id, model, COUNT(*) AS n, {WMAPE} AS wmape, AVG(abs(actual - predicted)) AS mae, sqrt(AVG(power(actual - predicted, 2))) AS rmse FROM scored_pairs GROUP BY 1, 2"


@query("h08_composite_score", SCORE_CTES.rstrip() + f", w AS ({W})\nSELECT series_id, model, round({COMPOSITE}, 6) AS composite_score FROM trend JOIN stds USING (series_id) JOIN w USING (series_id, model)")
def h08(spark: SparkSession, sf: str) -> DataFrame:
    return M.score_pairs(_pairs(spark, sf), KEY, _train_std(spark, sf)).select(*KEY, F.round("composite_score", 6).alias("composite_score"))


@query("h09_interval_coverage", PAIR_CTES + """SELECT series_id, model, round(AVG(CASE WHEN actual BETWEEN predicted * 0.9 AND predicted * 1.1 THEN 1.0 ELSE 0.0 END), 6) AS coverage
FROM scored_pairs GROUP BY 1, 2""")
def h09(spark: SparkSession, sf: str) -> DataFrame:
    banded = _pairs(spark, sf).withColumn("lower", F.col("predicted") * 0.9).withColumn("upper", F.col("predicted") * 1.1)
    return M.coverage(banded, KEY).withColumn("coverage", F.round("coverage", 6))


@query("h10_backtest_bias", PAIR_CTES + "SELECT series_id, model, round((SUM(actual) - SUM(predicted)) / (SUM(actual) + 1e-6), 6) AS forecast_bias FROM scored_pairs GROUP BY 1, 2")
def h10(spark: SparkSession, sf: str) -> DataFrame:
    return M.backtest_bias(_pairs(spark, sf), KEY).withColumn("forecast_bias", F.round("forecast_bias", 6))


@query("h11_all_metrics", SCORE_CTES.rstrip() + f", w AS ({W})\n" + f"""SELECT series_id, model, CAST(n AS BIGINT) AS n, round(wmape, 6) AS wmape, round(mae, 4) AS mae, round(rmse, 4) AS rmse,
  round(trend, 6) AS trend_error, round({COMPOSITE}, 6) AS composite_score FROM trend JOIN stds USING (series_id) JOIN w USING (series_id, model)""")
def h11(spark: SparkSession, sf: str) -> DataFrame:
    s = M.score_pairs(_pairs(spark, sf), KEY, _train_std(spark, sf))
    return s.select(*KEY, "n", *[F.round(c, 4 if c in ("mae", "rmse") else 6).alias(c) for c in ("wmape", "mae", "rmse", "trend_error", "composite_score")])


# ---- selection -----------------------------------------------------------------
@query("i01_overlap_gate", PAIR_CTES + """
SELECT series_id, model, CAST(n AS BIGINT) AS n_test, CAST(hit AS BIGINT) AS n_overlap, need AS needed, CASE WHEN hit >= need THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN hit < need THEN concat('Insufficient test overlap: ', CAST(hit AS STRING), ' pts, need ', CAST(need AS STRING)) END AS reason
FROM (SELECT series_id, model, COUNT(*) AS n, COUNT(CASE WHEN actual <> 0 AND actual > 35 THEN 1 END) AS hit, greatest(7, CAST(floor(0.3 * COUNT(*)) AS INT)) AS need
      FROM scored_pairs GROUP BY 1, 2) t""")
def i01(spark: SparkSession, sf: str) -> DataFrame:
    return S.overlap_gate(_pairs(spark, sf).withColumn("actual", F.when(F.col("actual") > 35, F.col("actual")).otherwise(0.0)))


@query("i02_univariate_winner", SCORE_CTES.rstrip() + f""", w AS ({W}), s AS (SELECT series_id, model, wmape, {COMPOSITE} AS composite_score, CASE model WHEN 'ByQuantity' THEN 2 ELSE 1 END AS rank
    FROM trend JOIN stds USING (series_id) JOIN w USING (series_id, model))
SELECT series_id, model, round(wmape, 6) AS wmape, round(composite_score, 6) AS composite_score FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY composite_score, rank) AS rn FROM s) t WHERE rn = 1""")
def i02(spark: SparkSession, sf: str) -> DataFrame:
    scores = M.score_pairs(_pairs(spark, sf), KEY, _train_std(spark, sf)).withColumn(
        "rank", F.when(F.col("model") == "ByQuantity", 2).otherwise(1)).withColumn("status", F.lit("completed"))
    return S.select_champion(scores).select(*KEY, F.round("wmape", 6).alias("wmape"), F.round("composite_score", 6).alias("composite_score"))


@query("i03_masked_scoring", PAIR_CTES + f"SELECT series_id, model, CAST(COUNT(*) AS BIGINT) AS n, round({WMAPE}, 6) AS wmape FROM (SELECT series_id, model, actual - 20 AS actual, predicted FROM scored_pairs) p WHERE actual >= 0 GROUP BY 1, 2")
def i03(spark: SparkSession, sf: str) -> DataFrame:
    masked = S.mask_truth(_pairs(spark, sf).withColumn("actual", F.col("actual") - 20))
    return M.score_pairs(masked, KEY).select(*KEY, "n", F.round("wmape", 6).alias("wmape"))


@query("i04_challenger_rule", SCORE_CTES.rstrip() + f""", w AS ({W}), s AS (SELECT series_id, model, wmape, fc_std FROM trend JOIN w USING (series_id, model))
SELECT u.series_id, coalesce(m.fc_std > 1e-6 AND (m.wmape * 0.4 < 0.95 * u.wmape OR (m.wmape * 0.4 < u.wmape AND m.fc_std >= 0.3 * u.fc_std)), false) AS accepted
FROM s u JOIN s m ON m.series_id = u.series_id AND m.model = 'ByPrice' WHERE u.model = 'ByQuantity'""")
def i04(spark: SparkSession, sf: str) -> DataFrame:
    scored = _pairs(spark, sf).groupBy("series_id", "model").agg(M.wmape().alias("wmape"), F.stddev_samp("predicted").alias("std"))
    uni = scored.where("model = 'ByQuantity'").select("series_id", F.col("wmape").alias("uni_wmape"), F.col("std").alias("uni_std"))
    mv = scored.where("model = 'ByPrice'").select("series_id", (F.col("wmape") * 0.4).alias("mv_wmape"), F.col("std").alias("mv_std"))
    return S.judge_challengers(uni.join(mv, "series_id")).select("series_id", "accepted")


FLOOR = """SELECT series_id, COUNT(CASE WHEN y = 0 THEN 1 END) / COUNT(*) AS zero_ratio, CASE WHEN COUNT(CASE WHEN y = 0 THEN 1 END) / COUNT(*) <= 0.1 THEN
    greatest(quantile_cont(CASE WHEN rn <= 90 AND y > 0 THEN y END, 0.1), MIN(CASE WHEN rn <= 90 AND y > 0 THEN y END)) * 0.9 END AS floor
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn FROM treated) GROUP BY 1"""


@query("i05_forecast_floor", ctes("supplier_daily", treated=TREATED_SQL, f=FLOOR) + """
SELECT t.series_id, t.ds, round(greatest(t.y - 30, coalesce(f.floor, 0), 0), 4) AS yhat FROM treated t LEFT JOIN f ON f.series_id = t.series_id""")
def i05(spark: SparkSession, sf: str) -> DataFrame:
    series = treated(spark, sf)
    forecasts = series.select("series_id", "ds", (F.col("y") - 30).alias("yhat"))
    return S.apply_floor(forecasts, S.forecast_floor(series)).withColumn("yhat", F.round("yhat", 4))


@query("i06_baseline_revert", ctes("scored_pairs", w=W) + """
SELECT c.series_id, CASE WHEN b.wmape < c.wmape THEN 'Baseline_SMA' ELSE c.model END AS model, round(least(b.wmape, c.wmape), 6) AS wmape, b.wmape < c.wmape AS reverted
FROM w c JOIN w b ON b.series_id = c.series_id AND b.model = 'ByQuantity' WHERE c.model = 'ByPrice'""")
def i06(spark: SparkSession, sf: str) -> DataFrame:
    scores = M.score_pairs(_pairs(spark, sf), KEY)
    out = S.revert_to_baseline(scores.where("model = 'ByPrice'"), scores.where("model = 'ByQuantity'"))
    return out.select("series_id", "model", F.round("wmape", 6).alias("wmape"), "reverted")


@query("i07_leaderboard_rows", ctes("scored_pairs", w=W, gate="""SELECT series_id, model, COUNT(CASE WHEN actual > 35 THEN 1 END) AS hit, greatest(7, CAST(floor(0.3 * COUNT(*)) AS INT)) AS need
    FROM scored_pairs GROUP BY 1, 2""", demand="SELECT series_id, actual AS y FROM scored_pairs WHERE model = 'ByPrice'", adi=ADI) + f"""
SELECT w.series_id, w.model AS model_name, 'Univariate' AS stage, CASE WHEN hit >= need THEN round(wmape, 6) END AS wmape, CASE WHEN hit >= need THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN hit < need THEN concat('Insufficient test overlap: ', CAST(hit AS STRING), ' pts, need ', CAST(need AS STRING)) END AS error_message, k.demand_type, round(k.adi, 6) AS adi, round(k.cv2, 6) AS cv2
FROM w JOIN gate USING (series_id, model) JOIN (SELECT series_id, {KIND} AS demand_type, adi, cv2 FROM adi) k ON k.series_id = w.series_id
UNION ALL SELECT series_id, 'SARIMAX', 'Univariate', NULL, 'failed', 'singular matrix', {KIND}, round(adi, 6), round(cv2, 6) FROM adi""")
def i07(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _pairs(spark, sf)
    gate = S.overlap_gate(pairs.withColumn("actual", F.when(F.col("actual") > 35, F.col("actual")).otherwise(0.0)))
    scores = M.score_pairs(pairs, KEY).join(gate.where("status = 'completed'").select(*KEY), KEY, "left_semi")
    failed = pairs.select("series_id").distinct().select("series_id", F.lit("SARIMAX").alias("model"), F.lit("singular matrix").alias("reason"))
    profile = D.demand_profile(pairs.where("model = 'ByPrice'").select("series_id", F.col("actual").alias("y")))
    board = S.leaderboard(scores, gate.where("status = 'skipped'"), failed, profile)
    return board.select("series_id", "model_name", "stage", F.round("wmape", 6).alias("wmape"), "status", "error_message", "demand_type",
                        F.round("adi", 6).alias("adi"), F.round("cv2", 6).alias("cv2"))


RUN = ["job_id", "sheet_name", "metric_name"]
BEST = """SELECT job_id, sheet_name, metric_name, CASE WHEN job_id % 6 = 0 THEN 'Ensemble[a+b]' WHEN job_id % 7 = 0 THEN NULL ELSE arg_max(model_name, position) END AS best_model,
    job_id % 4 = 0 AS is_multivariate, MIN(CASE WHEN isfinite(wmape) THEN wmape END) AS wmape FROM model_runs GROUP BY 1, 2, 3
  UNION ALL SELECT o_orderkey, 'sheet_none', 'metric_none', 'Theta', o_orderkey % 4 = 0, 0.25 FROM orders WHERE o_orderstatus = 'F'"""
BOARD_CTES = ctes("model_runs", headline=BEST)


def _headline(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from seriesloom.plans.inputs import table
    from seriesloom.functions.rules import finite
    board = load(spark, sf, "model_runs").drop("is_champion").withColumn("error_message", F.lit(None).cast("string"))
    best = F.when(F.col("job_id") % 6 == 0, "Ensemble[a+b]").when(F.col("job_id") % 7 == 0, None).otherwise(F.col("_top"))
    made = board.groupBy(*RUN).agg(F.max_by("model_name", "position").alias("_top"), F.min(finite(F.col("wmape"))).alias("wmape")).select(
        *RUN, best.alias("best_model"), (F.col("job_id") % 4 == 0).alias("is_multivariate"), "wmape")
    extra = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("job_id"), F.lit("sheet_none").alias("sheet_name"), F.lit("metric_none").alias("metric_name"),
        F.lit("Theta").alias("best_model"), (F.col("o_orderkey") % 4 == 0).alias("is_multivariate"), F.lit(0.25).alias("wmape"))
    headline = made.unionByName(extra)
    for s in S.SCORES:
        if s != "wmape":
            headline = headline.withColumn(s, F.lit(None).cast("double"))
    return board, headline


@query("i08_champion_flag", BOARD_CTES + """
SELECT m.id, m.model_name, m.model_name IS NOT DISTINCT FROM h.best_model AND h.best_model IS NOT NULL AND
  position = MIN(CASE WHEN m.model_name = h.best_model THEN position END) OVER (PARTITION BY m.job_id, m.sheet_name, m.metric_name) AS is_champion
FROM model_runs m LEFT JOIN headline h ON h.job_id = m.job_id AND h.sheet_name = m.sheet_name AND h.metric_name = m.metric_name""")
def i08(spark: SparkSession, sf: str) -> DataFrame:
    return S.flag_champions(*_headline(spark, sf)).select("id", "model_name", "is_champion")


_FLAG = """SELECT m.*, coalesce(m.model_name = h.best_model, false) AND position = MIN(CASE WHEN m.model_name = h.best_model THEN position END) OVER (PARTITION BY m.job_id, m.sheet_name, m.metric_name) AS won
  FROM model_runs m LEFT JOIN headline h ON h.job_id = m.job_id AND h.sheet_name = m.sheet_name AND h.metric_name = m.metric_name"""
_SEEN = "SELECT job_id, sheet_name, metric_name, bool_or(won) AS any_won FROM flagged GROUP BY 1, 2, 3"


def _made(where: str) -> str:
    # what is read more than once is worked out once
    once = BOARD_CTES.rstrip().replace("model_runs AS (", "model_runs AS MATERIALIZED (").replace("headline AS (", "headline AS MATERIALIZED (")
    return once + f""", flagged AS MATERIALIZED ({_FLAG}), seen AS MATERIALIZED ({_SEEN})
SELECT h.job_id, h.sheet_name, h.metric_name, h.best_model AS model_name, CASE WHEN h.is_multivariate THEN 'Multivariate' ELSE 'Univariate' END AS stage, round(h.wmape, 6) AS wmape, h.best_model IS NOT NULL AS is_champion
FROM headline h LEFT JOIN seen s ON s.job_id = h.job_id AND s.sheet_name = h.sheet_name AND s.metric_name = h.metric_name WHERE {where}"""


def _made_rows(spark: SparkSession, sf: str, from_empty: bool) -> DataFrame:
    board, headline = _headline(spark, sf)
    runs = S.model_runs(board, headline)
    keys = board.select(*RUN).distinct()
    made = runs.join(keys, RUN, "left_anti") if from_empty else runs.join(keys, RUN, "left_semi").join(
        board.select(*RUN, "model_name").distinct(), [*RUN, "model_name"], "left_anti")
    return made.select(*RUN, "model_name", "stage", F.round("wmape", 6).alias("wmape"), "is_champion")


@query("i09_champion_synthesis", _made("s.any_won = false AND h.best_model IS NOT NULL"))
def i09(spark: SparkSession, sf: str) -> DataFrame:
    return _made_rows(spark, sf, from_empty=False)


@query("i10_empty_board_fallback", _made("s.any_won IS NULL"))
def i10(spark: SparkSession, sf: str) -> DataFrame:
    return _made_rows(spark, sf, from_empty=True)


@query("i11_finite_scores", ctes("model_runs") + """
SELECT id, CASE WHEN isfinite(wmape) THEN round(wmape, 6) END AS wmape, CASE WHEN isfinite(composite_score) THEN round(composite_score, 6) END AS composite_score FROM model_runs""")
def i11(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.functions.rules import finite
    return load(spark, sf, "model_runs").select("id", *[F.round(finite(F.col(c)), 6).alias(c) for c in ("wmape", "composite_score")])


@query("i12_leaderboard_order", ctes("model_runs") + """
SELECT id, job_id, sheet_name, metric_name, CAST(row_number() OVER (PARTITION BY job_id, sheet_name, metric_name ORDER BY is_champion DESC, CASE WHEN NOT isnan(composite_score) THEN composite_score END ASC NULLS LAST, model_name, id) AS INT) AS place,
  model_name, is_champion FROM model_runs""")
def i12(spark: SparkSession, sf: str) -> DataFrame:
    placed = S.sort_leaderboard(load(spark, sf, "model_runs"), "composite_score", tiebreak=("model_name", "id"))
    return placed.select("id", *RUN, "place", "model_name", "is_champion")


@query("i13_assemble_records", VIEW_CTES + """
SELECT series_id, ds, round(MAX(CASE WHEN kind = 1 THEN v END), 4) AS train_actual, round(MAX(CASE WHEN kind = 2 THEN v END), 4) AS train_raw, round(MAX(CASE WHEN kind = 3 THEN v END), 4) AS test_actual,
  round(MAX(CASE WHEN kind = 4 THEN v END), 4) AS test_prediction FROM (
  SELECT series_id, ds, 1 AS kind, y AS v FROM views WHERE part = 'train' UNION ALL SELECT series_id, ds, CASE part WHEN 'train' THEN 2 ELSE 3 END, y FROM parts WHERE part <> 'full'
  UNION ALL SELECT series_id, ds, 4, coalesce(CASE WHEN day(ds) > 5 THEN y END, 0) FROM parts WHERE part = 'test') t GROUP BY 1, 2""")
def i13(spark: SparkSession, sf: str) -> DataFrame:
    series, cutoff, cleaned = views(spark, sf)
    parts = P.split_parts(series, cutoff)

    def tagged(df: DataFrame, kind: str, value=F.col("y")) -> DataFrame:
        return df.select("series_id", "ds", F.lit(kind).alias("kind"), value.alias("value"))
    test = parts.where("part = 'test'")
    rows = tagged(cleaned.where("part = 'train'"), "train_actual").unionByName(tagged(parts.where("part = 'train'"), "train_raw")).unionByName(
        tagged(test, "test_actual")).unionByName(tagged(test, "test_prediction", F.when(F.dayofmonth("ds") > 5, F.col("y"))))
    return S.assemble_records(rows).select("series_id", "ds", *[F.round(c, 4).alias(c) for c in ("train_actual", "train_raw", "test_actual", "test_prediction")])


@query("i14_status_rows", ctes("scored_pairs") + """
SELECT series_id, model, CASE WHEN series_id LIKE '%7' AND model = 'ByPrice' THEN 'failed' WHEN ok THEN 'completed' ELSE 'skipped' END AS status,
  CASE WHEN series_id LIKE '%7' AND model = 'ByPrice' THEN 'no convergence' END AS error
FROM (SELECT series_id, model, SUM(actual) > 15000 AS ok FROM scored_pairs GROUP BY 1, 2) t""")
def i14(spark: SparkSession, sf: str) -> DataFrame:
    totals = _pairs(spark, sf).groupBy("series_id", "model").agg(F.sum("actual").alias("total"))
    errors = totals.where("series_id like '%7' and model = 'ByPrice'").withColumn("error", F.lit("no convergence"))
    return S.status_rows(totals, totals.where("total > 15000"), errors)


@query("i15_boundary_date", ctes("stored_records", r="""SELECT concat(sheet_name, '/', CAST(job_id AS STRING)) AS series_id, ds, train_actual, CASE WHEN forecast > 30 THEN forecast END AS test_actual FROM stored_records""") + """
SELECT series_id, MAX(CASE WHEN ds < bare THEN ds END) AS boundary_date FROM (SELECT *, MIN(CASE WHEN train_actual IS NULL AND test_actual IS NULL THEN ds END) OVER (PARTITION BY series_id) AS bare FROM r) t GROUP BY 1""")
def i15(spark: SparkSession, sf: str) -> DataFrame:
    records = load(spark, sf, "stored_records").select(
        F.concat_ws("/", "sheet_name", F.col("job_id").cast("string")).alias("series_id"), "ds", "train_actual",
        F.when(F.col("forecast") > 30, F.col("forecast")).alias("test_actual"))
    return S.boundary_date(records)
