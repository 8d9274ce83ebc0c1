"""Queries for sources, typing and series preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seriesloom.functions import rules
from seriesloom.operators import prepare as P, typing as T
from seriesloom.plans.inputs import ctes, daily_series, load
from seriesloom.plans.registry import query

# ---- shared oracle steps -------------------------------------------------------
BOUNDS = "SELECT series_id, MIN(ds) AS s, MAX(ds) AS e FROM supplier_daily GROUP BY 1"
GRID = """SELECT b.series_id, CAST(b.d AS DATE) AS ds, x.y, x.ds IS NOT NULL AS was_observed
  FROM (SELECT series_id, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d FROM bounds) b
  LEFT JOIN supplier_daily x ON x.series_id = b.series_id AND x.ds = CAST(b.d AS DATE)"""
FILLS = """SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ds) AS pos,
    median(y) OVER (PARTITION BY {k}) AS med,
    last_value(y IGNORE NULLS) OVER (PARTITION BY {k} ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried,
    quantile_cont(y, 0.5) OVER (PARTITION BY {k}, isodow(ds) ORDER BY ds RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS dow_med,
    quantile_cont(y, 0.5) OVER (PARTITION BY {k} ORDER BY ds RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS near_med,
    quantile_cont(y, 0.5) OVER (PARTITION BY {k} ORDER BY ds RANGE BETWEEN INTERVAL 372 DAY PRECEDING AND INTERVAL 358 DAY PRECEDING) AS year_med
  FROM {grid}"""
OPENING = "SELECT {k}, median(y) FILTER (WHERE pos <= 30) AS open_med FROM fills GROUP BY {k}"
RECENT = "coalesce(dow_med, near_med, open_med, 0.0)"
YEARLY = f"coalesce(CASE WHEN pos > 372 THEN year_med END, {RECENT})"
SKEW = "CASE WHEN count(y) >= 3 AND stddev_pop(y) > 0 THEN skewness(y) END"
GRID_CTES = ctes("supplier_daily", bounds=BOUNDS, grid=GRID)
FILL_CTES = ctes("supplier_daily", bounds=BOUNDS, grid=GRID, fills=FILLS.format(k="series_id", grid="grid"),
                 opening=OPENING.format(k="series_id"))


def supplier_grid(spark: SparkSession, sf: str) -> DataFrame:
    return P.daily_grid(daily_series(spark, sf))


# ---- sources and shapes --------------------------------------------------------
@query("a02_multi_sheet_dataset", ctes("wide_sheets") + """
SELECT sheet, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(extra) AS BIGINT) AS n_extra, round(SUM(quantity), 2) AS quantity
FROM (SELECT sheet, quantity, NULL AS extra FROM wide_sheets WHERE sheet <> 'returns_R'
      UNION ALL SELECT sheet, quantity, discount FROM wide_sheets WHERE sheet = 'returns_R') u GROUP BY sheet""")
def a02(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.sources.tables import combine_sheets
    wide = load(spark, sf, "wide_sheets")
    sheets = {
        name: wide.where(F.col("sheet") == name).select("ds", "quantity", *(["discount"] if name == "returns_R" else []))
        for name in ("returns_A", "returns_N", "returns_R")
    }
    return combine_sheets(sheets).groupBy("sheet").agg(
        F.count("*").alias("n_rows"), F.count("discount").alias("n_extra"), F.round(F.sum("quantity"), 2).alias("quantity"))


@query("a03_wide_to_long", ctes("wide_sheets") + """
SELECT sheet, metric, CAST(COUNT(*) AS BIGINT) AS n, round(SUM(v), 2) AS total FROM (
  SELECT sheet, 'quantity' AS metric, quantity AS v FROM wide_sheets UNION ALL
  SELECT sheet, 'revenue', revenue FROM wide_sheets UNION ALL
  SELECT sheet, 'discount', discount FROM wide_sheets) u GROUP BY 1, 2""")
def a03(spark: SparkSession, sf: str) -> DataFrame:
    long = T.wide_to_long(load(spark, sf, "wide_sheets"), ["sheet", "ds"], ["quantity", "revenue", "discount"])
    return long.groupBy("sheet", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("y_raw").try_cast("double")), 2).alias("total"))


@query("a04_dataset_catalog", ctes("wide_sheets") + """
SELECT sheet, CAST(COUNT(*) AS BIGINT) AS row_count, 'ds' AS date_column, 'ds,quantity,revenue,discount' AS columns
FROM wide_sheets GROUP BY sheet""")
def a04(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.sources.tables import dataset_catalog
    wide = load(spark, sf, "wide_sheets")
    sheets = {n: wide.where(F.col("sheet") == n).drop("sheet") for n in ("returns_A", "returns_N", "returns_R")}
    return dataset_catalog(sheets).withColumn("columns", F.concat_ws(",", "columns"))


# ---- typing --------------------------------------------------------------------
def _ratio(column: str, position: int, reads: str) -> str:
    return (f"SELECT {position} AS position, '{column}' AS column_name, CAST(COUNT({column}) AS BIGINT) AS n_values, "
            f"CAST(COUNT(CASE WHEN {reads} THEN {column} END) AS BIGINT) AS n_dates FROM raw_orders")


_DATED = "try_cast({c} AS TIMESTAMP) IS NOT NULL"


@query("b01_infer_date_column", ctes("raw_orders", cols=" UNION ALL ".join([
    _ratio("amount", 1, _DATED.format(c="amount")), _ratio("placed", 2, _DATED.format(c="placed")),
    _ratio("big_number", 3, "big_number BETWEEN 1900 AND 2100"), _ratio("priority", 4, _DATED.format(c="priority")),
])) + """
SELECT column_name, n_values, n_dates, round(n_dates / n_values, 6) AS ratio,
  coalesce(position = (SELECT MIN(position) FROM cols WHERE n_dates / n_values >= 0.8), false) AS is_date_column FROM cols""")
def b01(spark: SparkSession, sf: str) -> DataFrame:
    raw = load(spark, sf, "raw_orders").drop("order_ref")
    return T.date_column_report(raw).select(
        "column_name", "n_values", "n_dates", F.round("ratio", 6).alias("ratio"), "is_date_column")


@query("b02_coerce_dates", ctes("raw_readings") + """
SELECT series_id, CAST(COUNT(*) AS BIGINT) AS rows_total, CAST(SUM(CASE WHEN try_cast(ds_raw AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unparseable_dates
FROM raw_readings GROUP BY 1""")
def b02(spark: SparkSession, sf: str) -> DataFrame:
    return T.typing_counts(T.type_readings(load(spark, sf, "raw_readings"))).drop("non_numeric_values")


@query("b03_coerce_numerics", ctes("raw_readings") + """
SELECT series_id, CAST(COUNT(CASE WHEN try_cast(ds_raw AS TIMESTAMP) IS NOT NULL AND y_raw IS NOT NULL AND try_cast(y_raw AS DOUBLE) IS NULL THEN 1 END) AS BIGINT) AS non_numeric_values,
  round(SUM(CASE WHEN try_cast(ds_raw AS TIMESTAMP) IS NOT NULL THEN try_cast(y_raw AS DOUBLE) END), 2) AS total
FROM raw_readings GROUP BY 1""")
def b03(spark: SparkSession, sf: str) -> DataFrame:
    typed = T.type_readings(load(spark, sf, "raw_readings"))
    totals = T.drop_undated(typed).groupBy("series_id").agg(F.round(F.sum("y"), 2).alias("total"))
    return T.typing_counts(typed).select("series_id", "non_numeric_values").join(totals, "series_id", "left")


@query("b04_metric_selection", ctes("wide_sheets") + """
SELECT metric, CAST(COUNT(v) AS BIGINT) AS n FROM (SELECT 'quantity' AS metric, quantity AS v FROM wide_sheets UNION ALL
  SELECT 'revenue', revenue FROM wide_sheets UNION ALL SELECT 'discount', discount FROM wide_sheets) u GROUP BY 1""")
def b04(spark: SparkSession, sf: str) -> DataFrame:
    wide = load(spark, sf, "wide_sheets")
    assert T.numeric_metrics(wide, ["revenue", "nope", "revenue", "quantity"]) == ["revenue", "quantity"]
    long = T.wide_to_long(wide, ["sheet", "ds"], T.numeric_metrics(wide))
    return long.groupBy("metric").agg(F.count("y_raw").alias("n"))


_CATALOG = "SELECT DISTINCT concat('returns_', l_returnflag) AS sheet, concat(CASE WHEN l_returnflag = 'R' AND l_linenumber > 4 THEN 'late_line_' ELSE 'line_' END, CAST(l_linenumber AS STRING)) AS column_name FROM lineitem"
_ASKED_SHEETS = "SELECT concat('returns_', l_returnflag) AS sheet FROM lineitem UNION SELECT concat('status_', o_orderstatus) FROM orders"
_ASKED_METRICS = "SELECT concat('line_', CAST(l_linenumber AS STRING)) AS metric FROM lineitem UNION SELECT concat('line_', o_orderstatus) FROM orders"


@query("b05_missing_selection", f"""
WITH cat AS ({_CATALOG}), sh AS ({_ASKED_SHEETS}), me AS ({_ASKED_METRICS})
SELECT sheet, CAST(NULL AS VARCHAR) AS metric, concat('Sheet ''', sheet, ''' isn''t in this file and will be skipped.') AS message
FROM sh WHERE sheet NOT IN (SELECT sheet FROM cat)
UNION ALL
SELECT sheet, metric, concat('''', metric, ''' isn''t a column in sheet ''', sheet, ''', so it won''t be forecast there.')
FROM sh JOIN me ON true WHERE sheet IN (SELECT sheet FROM cat) AND (sheet, metric) NOT IN (SELECT sheet, column_name FROM cat)""")
def b05(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.plans.inputs import table
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    returns = F.concat(F.lit("returns_"), "l_returnflag").alias("sheet")
    line = F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"))
    # columns of returned items over number 4 go by another name
    other = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") > 4)
    catalog = li.select(returns, F.when(other, F.concat(F.lit("late_"), line)).otherwise(line).alias("column_name")).distinct()
    sheets = li.select(returns).union(o.select(F.concat(F.lit("status_"), "o_orderstatus")))
    metrics = li.select(line.alias("metric")).union(o.select(F.concat(F.lit("line_"), "o_orderstatus")))
    return T.selection_report(catalog, sheets, metrics).select("sheet", "metric", "message")


@query("b06_covariate_columns", ctes("wide_sheets") + """
SELECT sheet, CAST(COUNT(revenue) AS BIGINT) AS n_revenue, CAST(COUNT(discount) AS BIGINT) AS n_discount FROM wide_sheets GROUP BY 1""")
def b06(spark: SparkSession, sf: str) -> DataFrame:
    wide = load(spark, sf, "wide_sheets")
    source, date_col, names = T.covariate_columns(wide, ["quantity", "revenue", "discount", "nope"], "quantity")
    return source.where(F.col(date_col).isNotNull()).groupBy("sheet").agg(*[F.count(n).alias(f"n_{n}") for n in names])


# ---- preparation ---------------------------------------------------------------
@query("c01_dedupe_keep_last", ctes("supplier_readings") + """
SELECT series_id, ds, round(y, 4) AS y, CAST(copies - 1 AS BIGINT) AS duplicates FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id, ds ORDER BY row_no DESC, y DESC NULLS LAST) AS rn,
    COUNT(*) OVER (PARTITION BY series_id, ds) AS copies FROM supplier_readings) t WHERE rn = 1""")
def c01(spark: SparkSession, sf: str) -> DataFrame:
    return P.keep_last(load(spark, sf, "supplier_readings")).select("series_id", "ds", F.round("y", 4).alias("y"), "duplicates")


CUSTOMER_SERIES = "SELECT concat('C', CAST(o_custkey AS STRING)) AS series_id, CAST(o_orderdate AS DATE) AS ds, SUM(o_totalprice) AS y FROM orders GROUP BY 1, 2"


def customer_series(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.plans.inputs import table
    o = table(spark, sf, "orders")
    return o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("series_id"),
                     F.col("o_orderdate").cast("date").alias("ds")).agg(F.sum("o_totalprice").alias("y"))


@query("c02_min_points_gate", f"WITH c AS ({CUSTOMER_SERIES})" + """
SELECT series_id, CAST(COUNT(y) AS BIGINT) AS usable, CASE WHEN COUNT(y) >= 12 THEN 'ready' ELSE 'skipped' END AS status,
  CASE WHEN COUNT(y) < 12 THEN concat('SKIP: Only ', CAST(COUNT(y) AS STRING), ' non-null points (min required = 12)') END AS reason
FROM c GROUP BY 1""")
def c02(spark: SparkSession, sf: str) -> DataFrame:
    return P.enough_points(customer_series(spark, sf), min_points=12)


@query("c03_daily_grid", GRID_CTES + """
SELECT series_id, ds, round(y, 4) AS y, was_observed FROM grid""")
def c03(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_grid(spark, sf).select("series_id", "ds", F.round("y", 4).alias("y"), "was_observed")


@query("c03b_anchored_grid", ctes("event_readings", hourly="""
  SELECT series_id, date_trunc('hour', ds) AS ds, arg_max(y, row_no) AS y FROM event_readings GROUP BY 1, 2""", b="""
  SELECT series_id, MIN(ds) AS s, MAX(ds) AS e FROM hourly GROUP BY 1""") + """
SELECT g.series_id, CAST(g.d AS DATE) AS ds, round(h.y, 4) AS y
FROM (SELECT series_id, unnest(generate_series(s, e, INTERVAL 1 DAY)) AS d FROM b) g
LEFT JOIN hourly h ON h.series_id = g.series_id AND h.ds = g.d""")
def c03b(spark: SparkSession, sf: str) -> DataFrame:
    hourly = load(spark, sf, "event_readings").withColumn("ds", F.date_trunc("hour", "ds").cast("timestamp_ntz"))
    grid = P.daily_grid(P.on_daily_grid(P.keep_last(hourly)).select("series_id", "ds", "y"))
    return grid.select("series_id", "ds", F.round("y", 4).alias("y"))


# readings with weekend zeros for some suppliers and spikes for others
TREATED = """
  SELECT series_id, ds, CASE WHEN CAST(substr(series_id, 2) AS INT) % 4 = 1 AND {dow} >= 5 THEN 0.0
    WHEN CAST(substr(series_id, 2) AS INT) % 4 = 2 AND y > 45 THEN y * 50
    WHEN CAST(substr(series_id, 2) AS INT) % 4 = 3 AND y > 20 THEN 0.0 ELSE y END AS y FROM {src}"""
TREATED_SQL = TREATED.format(dow="(isodow(ds) - 1)", src="supplier_daily")


def treated(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TREATED.format(dow="weekday(ds)", src="{src}"), src=daily_series(spark, sf))


FACTS = f"""SELECT series_id, COUNT(*) AS n_points, COUNT(CASE WHEN isodow(ds) > 5 THEN 1 END) AS weekend_points,
    COUNT(CASE WHEN isodow(ds) > 5 AND y = 0 THEN 1 END) AS weekend_zeros, COUNT(CASE WHEN y = 0 THEN 1 END) AS zeros,
    date_diff('day', MIN(ds), MAX(ds)) AS days_history, {SKEW} AS skew FROM treated GROUP BY 1"""
AUTO = """SELECT series_id, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(p) > 0 THEN corr(a, p) END AS autocorr FROM (
    SELECT series_id, p, CASE WHEN p IS NOT NULL THEN y END AS a FROM (
      SELECT series_id, y, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS p FROM treated WHERE y IS NOT NULL)) GROUP BY 1"""
TREAT_CTES = ctes("supplier_daily", treated=TREATED_SQL, facts=FACTS, auto=AUTO)


@query("c04_weekend_rule", TREAT_CTES + """
SELECT series_id, CAST(weekend_points AS BIGINT) AS weekend_points, CAST(weekend_zeros AS BIGINT) AS weekend_zeros,
  CASE WHEN weekend_points > 0 AND weekend_zeros / weekend_points >= 0.6 THEN 'zero' ELSE 'median' END AS weekend_rule FROM facts""")
def c04(spark: SparkSession, sf: str) -> DataFrame:
    return P.treatment_facts(treated(spark, sf)).select("series_id", "weekend_points", "weekend_zeros", P.weekend_rule().alias("weekend_rule"))


@query("c05_lag1_autocorrelation", TREAT_CTES + "SELECT series_id, round(autocorr, 6) AS autocorr FROM auto")
def c05(spark: SparkSession, sf: str) -> DataFrame:
    return P.lag1_autocorrelation(treated(spark, sf)).select("series_id", F.round("autocorr", 6).alias("autocorr"))


@query("c05b_autocorrelation_of_dense_readings", ctes("event_readings", treated="SELECT series_id, ds, arg_max(y, row_no) AS y FROM event_readings GROUP BY 1, 2", auto=AUTO)
       + "SELECT series_id, round(autocorr, 6) AS autocorr FROM auto")
def c05b(spark: SparkSession, sf: str) -> DataFrame:
    series = P.keep_last(load(spark, sf, "event_readings"))
    return P.lag1_autocorrelation(series, bounded=False).select("series_id", F.round("autocorr", 6).alias("autocorr"))


@query("c06_weekday_rule", TREAT_CTES + """
SELECT f.series_id, CASE WHEN n_points > 14 AND autocorr > 0.8 THEN 'ffill' WHEN days_history > 365 THEN 'yearly_seasonal_median'
  WHEN days_history > 90 THEN 'recent_seasonal_median' ELSE 'median' END AS weekday_rule FROM facts f JOIN auto a ON a.series_id = f.series_id""")
def c06(spark: SparkSession, sf: str) -> DataFrame:
    return P.treatment_facts(treated(spark, sf)).select("series_id", P.weekday_rule().alias("weekday_rule"))


@query("c07_intermittency_rule", TREAT_CTES + """
SELECT series_id, zeros / n_points > 0.3 AS intermittent_smoothing FROM facts""")
def c07(spark: SparkSession, sf: str) -> DataFrame:
    return P.treatment_facts(treated(spark, sf)).select("series_id", P.intermittency_rule().alias("intermittent_smoothing"))


@query("c08_outlier_rule", TREAT_CTES + """
SELECT series_id, round(skew, 6) AS skew, CASE WHEN abs(skew) > 2 THEN 'clip' ELSE 'none' END AS outlier_rule FROM facts""")
def c08(spark: SparkSession, sf: str) -> DataFrame:
    return P.treatment_facts(treated(spark, sf)).select("series_id", F.round("skew", 6).alias("skew"), P.outlier_rule().alias("outlier_rule"))


TREATMENT = """SELECT f.series_id,
    CASE WHEN zeros / n_points > 0.3 THEN 'zero' WHEN weekend_points > 0 AND weekend_zeros / weekend_points >= 0.6 THEN 'zero' ELSE 'median' END AS weekend_treatment,
    CASE WHEN n_points > 14 AND autocorr > 0.8 THEN 'ffill' WHEN days_history > 365 THEN 'yearly_seasonal_median'
      WHEN days_history > 90 THEN 'recent_seasonal_median' ELSE 'median' END AS weekday_treatment,
    CASE WHEN abs(skew) > 2 THEN 'clip' ELSE 'none' END AS outlier_treatment, zeros / n_points > 0.3 AS intermittent_smoothing
  FROM facts f JOIN auto a ON a.series_id = f.series_id"""


@query("c09_analyze_columns", ctes("wide_sheets", treated="""
  SELECT concat(sheet, '/quantity') AS series_id, ds, quantity AS y FROM wide_sheets UNION ALL
  SELECT concat(sheet, '/revenue'), ds, revenue FROM wide_sheets UNION ALL
  SELECT concat(sheet, '/discount'), ds, discount FROM wide_sheets""", facts=FACTS, auto=AUTO) + TREATMENT)
def c09(spark: SparkSession, sf: str) -> DataFrame:
    wide = load(spark, sf, "wide_sheets")
    long = T.wide_to_long(wide, ["sheet", "ds"], T.numeric_metrics(wide)).select(
        F.concat_ws("/", "sheet", "metric").alias("series_id"), "ds", F.col("y_raw").try_cast("double").alias("y"))
    return P.analyze_treatment(long)


def _with_rule(grid: DataFrame, weekday: str, weekend: str, outlier: str = "none") -> DataFrame:
    return grid.select("*", F.lit(weekday).alias("weekday_treatment"), F.lit(weekend).alias("weekend_treatment"),
                       F.lit(outlier).alias("outlier_treatment"))


def _imputed(spark: SparkSession, sf: str, weekday: str, weekend: str) -> DataFrame:
    return P.impute(_with_rule(daily_series(spark, sf), weekday, weekend)).select(
        "series_id", "ds", F.round("y", 4).alias("y"))


def _fill_sql(weekday: str, weekend: str) -> str:
    return FILL_CTES + f"""SELECT series_id, ds, round(coalesce(y, CASE WHEN isodow(ds) > 5 THEN {weekend} ELSE {weekday} END), 4) AS y
FROM fills JOIN opening USING (series_id)"""


@query("c10_impute_zero", _fill_sql("0.0", "0.0"))
def c10(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, "zero", "zero")


@query("c11_impute_median", _fill_sql("med", "0.0"))
def c11(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, "median", "zero")


@query("c12_impute_ffill", _fill_sql("carried", "carried"))
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, "ffill", "median")


@query("c13_recent_seasonal_median", _fill_sql(RECENT, RECENT))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, "recent_seasonal_median", "recent_seasonal_median")


@query("c14_yearly_seasonal_median", _fill_sql(YEARLY, "med"))
def c14(spark: SparkSession, sf: str) -> DataFrame:
    return _imputed(spark, sf, "yearly_seasonal_median", "median")


@query("c15_impute_in_order")
def c15(spark: SparkSession, sf: str) -> DataFrame:
    series = _with_rule(daily_series(spark, sf), "yearly_seasonal_median", "zero")
    return P.impute_in_order(series).select("series_id", "ds", F.round("y", 4).alias("y"))


@query("c16_iqr_clip", ctes("supplier_daily", treated=TREATED_SQL, q="""
  SELECT series_id, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM treated GROUP BY 1""") + """
SELECT series_id, ds, round(CASE WHEN q3 > q1 THEN least(y, q3 + 3 * (q3 - q1)) ELSE y END, 4) AS y FROM treated JOIN q USING (series_id)""")
def c16(spark: SparkSession, sf: str) -> DataFrame:
    return P.clip_outliers(_with_rule(treated(spark, sf), "median", "median", "clip")).select("series_id", "ds", F.round("y", 4).alias("y"))


@query("c17_non_negative_clip", ctes("supplier_daily") + """
SELECT series_id, ds, round(greatest(y - 25, 0), 4) AS y FROM supplier_daily""")
def c17(spark: SparkSession, sf: str) -> DataFrame:
    low = load(spark, sf, "supplier_daily").withColumn("y", F.col("y") - 25)
    return P.clip_negative(low).select("series_id", "ds", F.round("y", 4).alias("y"))


HORIZON, TEST_WINDOW = 60, 30
CUTOFF = f"""SELECT series_id, n, holdout, MIN(ds) FILTER (WHERE rn <= holdout) AS test_start FROM (
    SELECT series_id, ds, n, greatest(7, least({TEST_WINDOW}, CAST(floor(0.2 * n) AS INT))) AS holdout, rn FROM (
      SELECT series_id, ds, COUNT(*) OVER (PARTITION BY series_id) AS n, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS rn
      FROM treated)) GROUP BY 1, 2, 3"""
PARTS = """SELECT t.series_id, p.part, t.ds, t.y FROM treated t JOIN cutoff c USING (series_id),
    LATERAL (SELECT unnest([CASE WHEN t.ds < c.test_start THEN 'train' ELSE 'test' END, 'full']) AS part) p WHERE c.n >= 15"""
PART_GRID = """SELECT g.series_id, g.part, CAST(g.d AS DATE) AS ds, x.y, x.ds IS NOT NULL AS was_observed FROM (
      SELECT series_id, part, unnest(generate_series(MIN(ds), MAX(ds), INTERVAL 1 DAY)) AS d FROM parts GROUP BY 1, 2) g
    LEFT JOIN parts x ON x.series_id = g.series_id AND x.part = g.part AND x.ds = CAST(g.d AS DATE)"""
PART_FILLED = f"""SELECT f.series_id, f.part, ds, was_observed, outlier_treatment, coalesce(y,
      CASE WHEN weekday_treatment = 'ffill' THEN carried
        ELSE CASE CASE WHEN isodow(ds) > 5 THEN weekend_treatment ELSE weekday_treatment END
          WHEN 'zero' THEN 0.0 WHEN 'yearly_seasonal_median' THEN {YEARLY} WHEN 'recent_seasonal_median' THEN {RECENT} ELSE med END END) AS y
    FROM fills f JOIN opening o ON o.series_id = f.series_id AND o.part = f.part JOIN treatment t ON t.series_id = f.series_id"""
VIEWS = """SELECT series_id, part, ds, was_observed, greatest(0, CASE WHEN outlier_treatment = 'clip' AND q3 > q1 THEN least(y, q3 + 3 * (q3 - q1)) ELSE y END) AS y
    FROM (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY series_id, part) AS q1, quantile_cont(y, 0.75) OVER (PARTITION BY series_id, part) AS q3 FROM filled)"""
VIEW_CTES = ctes("supplier_daily", treated=TREATED_SQL, facts=FACTS, auto=AUTO, treatment=TREATMENT, cutoff=CUTOFF, parts=PARTS,
                 grid=PART_GRID, fills=FILLS.format(k="series_id, part", grid="grid"),
                 opening=OPENING.format(k="series_id, part"), filled=PART_FILLED, views=VIEWS)


def views(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(series, cutoff, cleaned views) of the treated supplier series."""
    series = treated(spark, sf)
    cutoff = P.split_cutoff(series, TEST_WINDOW)
    return series, cutoff, P.clean_views(series, P.analyze_treatment(series), cutoff)


@query("c18_clean_three_views", VIEW_CTES + """
SELECT series_id, part, CAST(COUNT(*) AS BIGINT) AS n, MIN(ds) AS first_day, MAX(ds) AS last_day, round(SUM(y), 2) AS total,
  round(SUM(y * (1 + extract(day FROM ds) / 31.0)), 2) AS day_weighted, round(MAX(y), 4) AS top FROM views GROUP BY 1, 2""")
def c18(spark: SparkSession, sf: str) -> DataFrame:
    return views(spark, sf)[2].groupBy("series_id", "part").agg(
        F.count("*").alias("n"), F.min("ds").alias("first_day"), F.max("ds").alias("last_day"), F.round(F.sum("y"), 2).alias("total"),
        F.round(F.sum(F.col("y") * (1 + F.dayofmonth("ds") / 31.0)), 2).alias("day_weighted"), F.round(F.max("y"), 4).alias("top"))


@query("c19_align_covariates", ctes("supplier_daily", x="""
  SELECT concat('S', CAST(l_suppkey AS STRING)) AS series_id, CASE WHEN l_linenumber % 2 = 1 THEN 'discount' ELSE 'tax' END AS x_name,
    CAST(l_shipdate AS DATE) AS ds, MAX(CASE WHEN l_linenumber % 2 = 1 THEN l_discount ELSE l_tax END) AS y
  FROM lineitem GROUP BY 1, 2, 3""") + """
SELECT d.series_id, n.x_name, d.ds, round(coalesce(last_value(x.y IGNORE NULLS) OVER (PARTITION BY d.series_id, n.x_name ORDER BY d.ds
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0), 4) AS x
FROM supplier_daily d JOIN (SELECT DISTINCT series_id, x_name FROM x) n ON n.series_id = d.series_id
LEFT JOIN x ON x.series_id = d.series_id AND x.x_name = n.x_name AND x.ds = d.ds""")
def c19(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.plans.inputs import table
    li = table(spark, sf, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    name = F.when(odd, "discount").otherwise("tax")
    value = F.when(odd, F.col("l_discount")).otherwise(F.col("l_tax"))
    x = li.groupBy(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("series_id"), name.alias("x_name"),
        F.col("l_shipdate").cast("date").alias("ds")).agg(F.max(value).alias("y"))
    return P.align_covariates(load(spark, sf, "supplier_daily"), x).withColumn("x", F.round("x", 4))


@query("c20_column_health", ctes("wide_sheets", long="""
  SELECT 'quantity' AS metric, quantity - 300 AS y FROM wide_sheets UNION ALL SELECT 'revenue', revenue FROM wide_sheets UNION ALL
  SELECT 'discount', CASE WHEN discount < 0.03 THEN NULL ELSE discount - 0.1 END FROM wide_sheets UNION ALL SELECT 'empty', NULL FROM wide_sheets""") + f"""
SELECT metric, CASE WHEN COUNT(y) = 0 THEN 'Empty' ELSE 'Ok' END AS status, CAST(COUNT(*) AS BIGINT) AS total, CAST(COUNT(*) - COUNT(y) AS BIGINT) AS missing,
  round((COUNT(*) - COUNT(y)) / COUNT(*) * 100, 1) AS missing_pct, CAST(COUNT(CASE WHEN y = 0 THEN 1 END) AS BIGINT) AS zeros,
  CAST(COUNT(CASE WHEN y < 0 THEN 1 END) AS BIGINT) AS negatives, round(AVG(y), 2) AS mean, round(stddev_samp(y), 2) AS std,
  round({SKEW}, 2) AS skew, round(MIN(y), 2) AS min, round(MAX(y), 2) AS max FROM long GROUP BY 1""")
def c20(spark: SparkSession, sf: str) -> DataFrame:
    w = load(spark, sf, "wide_sheets").select(
        (F.col("quantity") - 300).alias("quantity"), "revenue",
        F.when(F.col("discount") >= 0.03, F.col("discount") - 0.1).alias("discount"), F.lit(None).cast("double").alias("empty"))
    return P.column_health(w.unpivot([], ["quantity", "revenue", "discount", "empty"], "metric", "y"))


@query("c21_holdout_split", ctes("supplier_daily", treated=TREATED_SQL, cutoff=CUTOFF) + """
SELECT series_id, CAST(n AS BIGINT) AS n, holdout, test_start, CASE WHEN n < 15 THEN 'too_short' ELSE 'ready' END AS status FROM cutoff""")
def c21(spark: SparkSession, sf: str) -> DataFrame:
    return P.split_cutoff(treated(spark, sf), TEST_WINDOW)


@query("c22_effective_horizon", f"WITH c AS ({CUSTOMER_SERIES})" + """
SELECT series_id, CAST(COUNT(*) AS BIGINT) AS n, least(60, greatest(14, CAST(floor(0.3 * COUNT(*)) AS INT))) AS effective_horizon FROM c GROUP BY 1""")
def c22(spark: SparkSession, sf: str) -> DataFrame:
    counts = customer_series(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"))
    return counts.withColumn("effective_horizon", rules.effective_horizon(F.col("n"), HORIZON))


FREQ_SERIES = f"""
  SELECT series_id, CAST(ds AS TIMESTAMP) AS ds FROM supplier_daily UNION ALL
  SELECT DISTINCT concat('week ', o_orderpriority), CAST(CAST(date_trunc('week', o_orderdate) AS DATE) AS TIMESTAMP) FROM orders UNION ALL
  SELECT DISTINCT concat('month ', o_orderpriority), CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS TIMESTAMP) FROM orders UNION ALL
  SELECT DISTINCT concat('hour ', event_type), date_trunc('hour', ts) FROM events"""
GAPS = """SELECT series_id, COUNT(*) AS n_gaps, MIN(gap) AS lo, MAX(gap) AS hi, median(gap) AS med, bool_and(day(ds) = 1 AND day(prev) = 1) AS ms FROM (
    SELECT series_id, ds, prev, date_diff('microsecond', prev, ds) / 86400000000.0 AS gap FROM (
      SELECT series_id, ds, lag(ds) OVER (PARTITION BY series_id ORDER BY ds) AS prev FROM {src})
    WHERE prev IS NOT NULL) GROUP BY 1"""
FREQ = """CASE WHEN n_gaps >= 2 AND ms AND lo >= 28 AND hi <= 31 THEN 'MS' WHEN n_gaps >= 2 AND lo = hi AND lo = 1 THEN 'D'
    WHEN n_gaps >= 2 AND lo = hi AND lo = 7 THEN 'W' WHEN med <= 1 / 24.0 THEN 'h' WHEN med <= 4 / 24.0 THEN '4h' WHEN med <= 1 THEN 'D'
    WHEN med <= 7 THEN 'W' WHEN med <= 31 THEN 'MS' ELSE 'D' END"""


def freq_series(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.plans.inputs import table
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")

    def trunc(unit: str, label: str) -> DataFrame:
        return o.select(F.concat(F.lit(label), "o_orderpriority").alias("series_id"),
                        F.date_trunc(unit, "o_orderdate").cast("timestamp_ntz").alias("ds")).distinct()
    return (
        load(spark, sf, "supplier_daily").select("series_id", F.col("ds").cast("timestamp_ntz").alias("ds"))
        .unionByName(trunc("week", "week ")).unionByName(trunc("month", "month "))
        .unionByName(e.select(F.concat(F.lit("hour "), "event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds")).distinct())
    )


@query("c23_frequency", ctes("supplier_daily", s=FREQ_SERIES, gaps=GAPS.format(src="s")) + f"""
SELECT series_id, round(med, 6) AS median_gap, {FREQ} AS freq FROM gaps""")
def c23(spark: SparkSession, sf: str) -> DataFrame:
    return P.frequency(P.gap_facts(freq_series(spark, sf), bounded=False)).withColumn("median_gap", F.round("median_gap", 6))


@query("c24_seasonal_period", ctes("supplier_daily", s=FREQ_SERIES, gaps=GAPS.format(src="s")) + f"""
SELECT series_id, CASE freq WHEN 'W' THEN 52 WHEN 'MS' THEN 12 WHEN 'h' THEN 24 ELSE 7 END AS period FROM (SELECT series_id, {FREQ} AS freq FROM gaps) f""")
def c24(spark: SparkSession, sf: str) -> DataFrame:
    return P.frequency(P.gap_facts(freq_series(spark, sf))).select("series_id", P.seasonal_period(F.col("freq")).alias("period"))


@query("c25_future_calendar", ctes("supplier_daily", s=FREQ_SERIES, gaps=GAPS.format(src="s"), f=f"SELECT series_id, {FREQ} AS freq FROM gaps",
                                   last="SELECT series_id, MAX(ds) AS last_ds FROM s GROUP BY 1") + """
SELECT series_id, step, strftime(CASE freq WHEN 'MS' THEN CAST(date_trunc('month', last_ds) AS TIMESTAMP) + to_months(step) WHEN 'h' THEN last_ds + to_hours(step)
    WHEN '4h' THEN last_ds + to_hours(step * 4) WHEN 'W' THEN last_ds + to_days(step * 7) ELSE last_ds + to_days(step) END, '%Y-%m-%d %H:%M') AS ds
FROM f JOIN last USING (series_id), LATERAL (SELECT CAST(unnest(generate_series(1, 14)) AS INT) AS step) g""")
def c25(spark: SparkSession, sf: str) -> DataFrame:
    series = freq_series(spark, sf)
    last = series.groupBy("series_id").agg(F.max("ds").alias("last_ds")).join(
        P.frequency(P.gap_facts(series)).select("series_id", "freq"), "series_id").withColumn("horizon", F.lit(14))
    return P.future_calendar(last).withColumn("ds", F.date_format("ds", "yyyy-MM-dd HH:mm"))
