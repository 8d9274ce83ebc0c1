"""Queries for edits, realized accuracy and run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seriesloom.operators import edits as E, history as H, realized as R
from seriesloom.plans.inputs import ctes, load
from seriesloom.plans.registry import query

RUN = ["job_id", "sheet_name", "metric_name"]


# ---- edits ---------------------------------------------------------------------
def stored_edits(spark: SparkSession, sf: str) -> DataFrame:
    dows = F.when(F.col("weekend_only"), F.array(F.lit(5), F.lit(6)))
    return load(spark, sf, "stored_edits").withColumn("days_of_week", dows).drop("weekend_only")


def step_sql(value: str, n: int) -> str:
    """One edit of sequence ``n`` applied to ``value`` for every record."""
    hit = (f"e{n}.sequence_no IS NOT NULL AND (e{n}.date_from IS NULL OR r.ds >= e{n}.date_from) AND (e{n}.date_to IS NULL OR r.ds <= e{n}.date_to) "
           f"AND (NOT e{n}.weekend_only OR isodow(r.ds) > 5)")
    new = {1: f"{value} * 1.2", 2: f"least(greatest({value}, 10.0), 40.0)", 3: "7.5"}[n]
    return f"CASE WHEN {value} IS NOT NULL AND {hit} THEN {new} ELSE {value} END"


JOINS = " ".join(
    f"LEFT JOIN stored_edits e{n} ON e{n}.job_id = r.job_id AND e{n}.sheet_name = r.sheet_name AND e{n}.sequence_no = {n}" for n in (1, 2, 3))
EDIT_CTES = ctes(
    "stored_records", "stored_edits",
    a=f"SELECT r.*, {step_sql('r.forecast', 1)} AS f1 FROM stored_records r {JOINS}",
    b=f"SELECT r.*, {step_sql('r.f1', 2)} AS f2 FROM a r {JOINS}",
    c=f"SELECT r.*, {step_sql('r.f2', 3)} AS f3 FROM b r {JOINS}",
)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "stored_records")


def _hit(n: int) -> str:
    return (f"(e.date_from IS NULL OR r.ds >= e.date_from) AND (e.date_to IS NULL OR r.ds <= e.date_to) AND (NOT e.weekend_only OR isodow(r.ds) > 5) "
            f"AND e.sequence_no = {n} AND r.{'forecast' if n == 1 else f'f{n - 1}'} IS NOT NULL")


@query("j01_edit_predicate", ctes("stored_records", "stored_edits") + """
SELECT r.job_id, r.sheet_name, r.ds, e.sequence_no, r.forecast IS NOT NULL AND (e.date_from IS NULL OR r.ds >= e.date_from) AND (e.date_to IS NULL OR r.ds <= e.date_to)
  AND (NOT e.weekend_only OR isodow(r.ds) > 5) AS touched FROM stored_records r JOIN stored_edits e ON e.job_id = r.job_id AND e.sheet_name = r.sheet_name""")
def j01(spark: SparkSession, sf: str) -> DataFrame:
    return E.replay_steps(_records(spark, sf), stored_edits(spark, sf)).select("job_id", "sheet_name", "ds", "sequence_no", "touched")


def _single(name: str, kind: str, n: int, new: str) -> None:
    @query(name, ctes("stored_records", "stored_edits") + f"""
SELECT r.job_id, r.sheet_name, r.ds, round(CASE WHEN r.forecast IS NOT NULL AND (e.date_from IS NULL OR r.ds >= e.date_from) AND (e.date_to IS NULL OR r.ds <= e.date_to)
  AND (NOT e.weekend_only OR isodow(r.ds) > 5) THEN {new} ELSE r.forecast END, 4) AS forecast FROM stored_records r JOIN stored_edits e ON e.job_id = r.job_id AND e.sheet_name = r.sheet_name WHERE e.sequence_no = {n}""")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        only = stored_edits(spark, sf).where(F.col("operation_type") == kind)
        return E.replay_steps(_records(spark, sf), only).select("job_id", "sheet_name", "ds", F.round("forecast_after", 4).alias("forecast"))


_single("j02_set_value_range", "set_value_range", 3, "7.5")
_single("j03_scale_range", "scale_range", 1, "r.forecast * 1.2")
_single("j04_clip_bounds", "clip_bounds", 2, "least(greatest(r.forecast, 10.0), 40.0)")


@query("j05_replay", EDIT_CTES + "SELECT job_id, sheet_name, metric_name, ds, round(f3, 4) AS edited_forecast FROM c")
def j05(spark: SparkSession, sf: str) -> DataFrame:
    return E.replay(_records(spark, sf), stored_edits(spark, sf)).select(*RUN, "ds", F.round("edited_forecast", 4).alias("edited_forecast"))


@query("j06_affected_before", EDIT_CTES + " UNION ALL ".join(
    f"SELECT r.job_id, r.sheet_name, r.ds, e.sequence_no, round(r.{'forecast' if n == 1 else f'f{n - 1}'}, 4) AS forecast FROM c r JOIN stored_edits e ON e.job_id = r.job_id AND e.sheet_name = r.sheet_name WHERE {_hit(n)}"
    for n in (1, 2, 3)))
def j06(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.affected_before(_records(spark, sf), stored_edits(spark, sf))
    return rows.select("job_id", "sheet_name", "ds", "sequence_no", F.round("forecast", 4).alias("forecast"))


_LEFT = "SELECT * FROM (SELECT *, MAX(sequence_no) OVER (PARTITION BY job_id, sheet_name) AS top FROM all_edits) x WHERE sequence_no < top"


@query("j07_revert_latest", ctes("stored_records", all_edits=ctes("stored_edits").strip() + " SELECT * FROM stored_edits", stored_edits=_LEFT,
                                 a=f"SELECT r.*, {step_sql('r.forecast', 1)} AS f1 FROM stored_records r {JOINS}",
                                 b=f"SELECT r.*, {step_sql('r.f1', 2)} AS f2 FROM a r {JOINS}") + "SELECT job_id, sheet_name, ds, round(f2, 4) AS edited_forecast FROM b")
def j07(spark: SparkSession, sf: str) -> DataFrame:
    remaining = E.revert_latest(stored_edits(spark, sf))
    return E.replay(_records(spark, sf), remaining).select("job_id", "sheet_name", "ds", F.round("edited_forecast", 4).alias("edited_forecast"))


_BODY = r"CASE WHEN json_valid(raw_text) THEN raw_text WHEN json_valid(regexp_extract(raw_text, '(?s)\{.*\}')) THEN regexp_extract(raw_text, '(?s)\{.*\}') END"
_FIELDS = ", ".join(f"json_extract_string(j, '$.{n}') AS {n}" for n in ("operation_type", "value", "scale_pct", "min_value", "max_value", "date_from"))


@query("j08_validate_operations", ctes("edit_requests", body=f"SELECT request_id, {_BODY} AS j FROM edit_requests",
       f=f"SELECT request_id, j, {_FIELDS}, CAST(json_extract(j, '$.days_of_week') AS INT[]) AS dows FROM body") + """
SELECT request_id, rejected, CASE WHEN rejected IS NULL THEN operation_type END AS operation_type,
  CASE WHEN rejected IS NULL THEN round(coalesce(try_cast(value AS DOUBLE), try_cast(scale_pct AS DOUBLE), try_cast(max_value AS DOUBLE)), 4) END AS amount FROM (
  SELECT *, CASE WHEN j IS NULL THEN 'not valid JSON' WHEN operation_type = 'none' THEN 'not a forecast edit'
    WHEN operation_type IS NULL OR operation_type NOT IN ('set_value_range', 'scale_range', 'clip_bounds') THEN 'unknown operation type'
    WHEN date_from IS NOT NULL AND try_cast(date_from AS DATE) IS NULL THEN 'unreadable parameter'
    WHEN len(list_filter(dows, lambda d: d < 0 OR d > 6)) > 0 THEN 'days_of_week values must be 0-6'
    WHEN operation_type = 'set_value_range' AND value IS NULL THEN 'value is required'
    WHEN operation_type = 'scale_range' AND scale_pct IS NULL THEN 'scale_pct is required'
    WHEN operation_type = 'clip_bounds' AND CAST(max_value AS DOUBLE) < CAST(min_value AS DOUBLE) THEN 'max_value must be >= min_value' END AS rejected FROM f) v""")
def j08(spark: SparkSession, sf: str) -> DataFrame:
    return E.validate(load(spark, sf, "edit_requests")).select(
        "request_id", "rejected", F.col("op.operation_type").alias("operation_type"),
        F.round(F.coalesce("op.value", "op.scale_pct", "op.max_value"), 4).alias("amount"))


@query("j09_metric_context", ctes("stored_records") + """
SELECT job_id, sheet_name, metric_name, CAST(COUNT(train_actual) AS BIGINT) AS history_points, round(AVG(train_actual), 4) AS history_mean, MIN(train_actual) AS history_min, MAX(train_actual) AS history_max,
  CAST(COUNT(forecast) AS BIGINT) AS forecast_points, round(AVG(forecast), 4) AS forecast_mean, MIN(forecast) AS forecast_min, MAX(forecast) AS forecast_max,
  MIN(CASE WHEN forecast IS NOT NULL THEN ds END) AS forecast_from, MAX(CASE WHEN forecast IS NOT NULL THEN ds END) AS forecast_to FROM stored_records GROUP BY 1, 2, 3""")
def j09(spark: SparkSession, sf: str) -> DataFrame:
    return E.metric_context(_records(spark, sf)).withColumn("history_mean", F.round("history_mean", 4)).withColumn("forecast_mean", F.round("forecast_mean", 4))


# ---- realized accuracy ---------------------------------------------------------
ACTUAL = """SELECT job_id, sheet_name, metric_name, ds, y FROM (SELECT *, row_number() OVER (PARTITION BY job_id, sheet_name, metric_name, ds ORDER BY row_no DESC, y DESC NULLS LAST) AS rn
  FROM arrived_actuals) t WHERE rn = 1"""
COMPARED = """SELECT f.job_id, f.sheet_name, f.metric_name, COUNT(*) AS forecast_points, COUNT(a.y) AS matched, SUM(abs(a.y)) AS size, SUM(abs(a.y - f.forecast)) AS miss, SUM(a.y) AS sa,
    SUM(CASE WHEN a.y IS NOT NULL THEN f.forecast END) AS sf, string_agg(CASE WHEN a.y IS NOT NULL THEN concat(strftime(f.ds, '%Y-%m-%d'), ':', CAST(CAST(round(a.y * 100) AS BIGINT) AS STRING), ':', CAST(CAST(round(f.forecast) AS BIGINT) AS STRING)) END, ' ' ORDER BY f.ds) AS points
  FROM stored_records f LEFT JOIN actual a ON a.job_id = f.job_id AND a.sheet_name = f.sheet_name AND a.metric_name = f.metric_name AND a.ds = f.ds WHERE f.forecast IS NOT NULL GROUP BY 1, 2, 3"""
REALIZED_CTES = ctes("stored_records", "arrived_actuals", actual=ACTUAL, compared=COMPARED)
STATUS = "CASE WHEN matched <= 0 THEN 'no_overlap' WHEN matched >= forecast_points THEN 'complete' ELSE 'partial' END"


def _actuals(spark: SparkSession, sf: str) -> DataFrame:
    return R.actual_series(load(spark, sf, "arrived_actuals"), RUN, ("row_no", "y"))


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return R.compare(R.forecast_series(_records(spark, sf)), _actuals(spark, sf))


_JOB_SHEETS = "SELECT DISTINCT o_custkey AS job_id, o_orderstatus AS job_sheet FROM orders"
_UPLOAD_SHEETS = "SELECT DISTINCT CASE WHEN o_totalprice > 150000 THEN o_custkey ELSE -o_custkey END AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS upload_sheet FROM orders"
PAIRS = """SELECT j.job_id, j.job_sheet, u.upload_sheet FROM js j JOIN us u ON u.job_id = j.job_id AND u.upload_sheet = j.job_sheet UNION
  SELECT job_id, MIN(job_sheet), MIN(upload_sheet) FROM js JOIN us USING (job_id) GROUP BY 1 HAVING COUNT(DISTINCT job_sheet) = 1 AND COUNT(DISTINCT upload_sheet) = 1"""


def _uploaded(price: int) -> Column:
    """The job an upload belongs to; those of cheaper orders belong to jobs that do not exist."""
    return F.when(F.col("o_totalprice") > price, F.col("o_custkey")).otherwise(-F.col("o_custkey")).alias("job_id")


def _sheets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from seriesloom.plans.inputs import table
    o = table(spark, sf, "orders")
    jobs = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("job_sheet")).distinct()
    ups = o.select(_uploaded(150000), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("X").alias("upload_sheet")).distinct()
    return jobs, ups


@query("k01_pair_sheets", ctes(js=_JOB_SHEETS, us=_UPLOAD_SHEETS) + PAIRS)
def k01(spark: SparkSession, sf: str) -> DataFrame:
    return R.pair_sheets(*_sheets(spark, sf))


@query("k02_actual_series", REALIZED_CTES + "SELECT job_id, sheet_name, metric_name, ds, round(y, 4) AS y FROM actual")
def k02(spark: SparkSession, sf: str) -> DataFrame:
    return _actuals(spark, sf).withColumn("y", F.round("y", 4))


@query("k03_forecast_series", ctes("forecast_log") + """SELECT job_id, sheet_name, metric_name, CAST(ds AS DATE) AS ds, round(forecast, 4) AS forecast FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, sheet_name, CAST(ds AS DATE) ORDER BY ds DESC, row_no DESC) AS nth FROM forecast_log WHERE forecast IS NOT NULL) t WHERE nth = 1""")
def k03(spark: SparkSession, sf: str) -> DataFrame:
    return R.forecast_series(load(spark, sf, "forecast_log"), order=("ds", "row_no")).withColumn("forecast", F.round("forecast", 4))


@query("k04_compare", REALIZED_CTES + """SELECT job_id, sheet_name, metric_name, CAST(forecast_points AS BIGINT) AS forecast_points, CAST(matched AS BIGINT) AS matched_points, round(CASE WHEN size > 0 THEN miss / size END, 6) AS wmape,
  round(miss / nullif(matched, 0), 4) AS mae, round(CASE WHEN size > 0 THEN (sf - sa) / size END, 6) AS bias, round(coalesce(sa, 0), 4) AS actual_total, round(coalesce(sf, 0), 4) AS forecast_total, coalesce(points, '') AS points FROM compared""")
def k04(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", F.transform("points", lambda p: F.concat_ws(
        ":", p["date"].cast("string"), F.round(p["actual"] * 100).cast("bigint").cast("string"), F.round(p["forecast"]).cast("bigint").cast("string"))))
    c = _compared(spark, sf)
    return c.select(*RUN, "forecast_points", "matched_points", F.round("wmape", 6).alias("wmape"), F.round("mae", 4).alias("mae"), F.round("bias", 6).alias("bias"),
                    F.round("actual_total", 4).alias("actual_total"), F.round("forecast_total", 4).alias("forecast_total"), text.alias("points"))


@query("k05_evaluation_status", REALIZED_CTES + f"SELECT job_id, sheet_name, metric_name, {STATUS} AS status FROM compared")
def k05(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select(*RUN, "status")


_METRICS = "SELECT DISTINCT o_custkey AS job_id, o_orderstatus AS job_sheet, o_orderpriority AS metric FROM orders"
_UPCOLS = "SELECT DISTINCT CASE WHEN o_totalprice > 400000 THEN o_custkey ELSE -o_custkey END AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'X' END AS upload_sheet, o_orderpriority AS metric FROM orders"


@query("k06_skip_reasons", ctes(js=_JOB_SHEETS, us=_UPLOAD_SHEETS, pairs=PAIRS, m=_METRICS, uc=_UPCOLS) + """
SELECT m.job_id, m.job_sheet, m.metric, p.upload_sheet, CASE WHEN p.upload_sheet IS NULL THEN 'sheet_unpaired' WHEN h.metric IS NULL THEN 'metric_missing' END AS reason,
  NOT bool_or(m.metric IN (SELECT x.metric FROM uc x WHERE x.job_id = m.job_id)) OVER (PARTITION BY m.job_id) AS file_rejected
FROM m LEFT JOIN pairs p ON p.job_id = m.job_id AND p.job_sheet = m.job_sheet LEFT JOIN uc h ON h.job_id = m.job_id AND h.upload_sheet = p.upload_sheet AND h.metric = m.metric""")
def k06(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.plans.inputs import table
    o = table(spark, sf, "orders")
    jobs, ups = _sheets(spark, sf)
    metrics = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("job_sheet"), F.col("o_orderpriority").alias("metric")).distinct()
    columns = o.select(
        _uploaded(400000), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("X").alias("upload_sheet"), F.col("o_orderpriority").alias("metric"))
    return R.skip_reasons(metrics, R.pair_sheets(jobs, ups), columns)


@query("k07_actuals_last_date", REALIZED_CTES + "SELECT job_id, sheet_name, metric_name, MAX(CASE WHEN y IS NOT NULL THEN ds END) AS actuals_last_date FROM actual GROUP BY 1, 2, 3")
def k07(spark: SparkSession, sf: str) -> DataFrame:
    return R.actuals_last_date(_actuals(spark, sf), RUN)


NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, sheet_name, metric_name ORDER BY created_at DESC, id DESC) AS rn FROM evaluations) t WHERE rn = 1"


@query("k08_newest_evaluation", ctes("evaluations", n=NEWEST) + "SELECT id, job_id, sheet_name, metric_name, matched_points, round(wmape, 6) AS wmape, created_at FROM n")
def k08(spark: SparkSession, sf: str) -> DataFrame:
    return R.newest_evaluations(load(spark, sf, "evaluations")).select("id", *RUN, "matched_points", F.round("wmape", 6).alias("wmape"), "created_at")


@query("k09_awaiting_view", ctes("stored_records", "evaluations", ev="SELECT * REPLACE ('quantity' AS metric_name, CASE WHEN sheet_name = 'sheet_R' THEN 'sheet_gone' ELSE sheet_name END AS sheet_name) FROM evaluations", n=NEWEST.replace("FROM evaluations", "FROM ev")) + """
SELECT f.job_id, f.sheet_name, f.metric_name, CAST(f.n AS BIGINT) AS forecast_points, forecast_start, forecast_end, CASE WHEN n.id IS NULL THEN 'awaiting_actuals' WHEN matched_points <= 0 THEN 'no_overlap'
  WHEN matched_points >= f.n THEN 'complete' ELSE 'partial' END AS status, round(CASE WHEN matched_points > 0 THEN n.wmape END, 6) AS wmape, CASE WHEN matched_points > 0 THEN matched_points END AS matched_points
FROM (SELECT job_id, sheet_name, metric_name, COUNT(*) AS n, MIN(ds) AS forecast_start, MAX(ds) AS forecast_end FROM stored_records WHERE forecast IS NOT NULL GROUP BY 1, 2, 3) f
LEFT JOIN n ON n.job_id = f.job_id AND n.sheet_name = f.sheet_name AND n.metric_name = f.metric_name""")
def k09(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "evaluations").withColumn("metric_name", F.lit("quantity")).drop("forecast_points").withColumn(
        "sheet_name", F.when(F.col("sheet_name") == "sheet_R", "sheet_gone").otherwise(F.col("sheet_name")))
    return R.realized_view(R.forecast_series(_records(spark, sf)), ev).withColumn("wmape", F.round("wmape", 6))


@query("k10_adjusted_scores", EDIT_CTES.rstrip() + f", arrived AS ({ctes('arrived_actuals').strip()} SELECT * FROM arrived_actuals), actual AS ({ACTUAL.replace('FROM arrived_actuals', 'FROM arrived')})\n" + """
SELECT c.job_id, c.sheet_name, c.metric_name, CAST(COUNT(*) AS BIGINT) AS matched_points, round(CASE WHEN SUM(abs(y)) > 0 THEN SUM(abs(y - f3)) / SUM(abs(y)) END, 6) AS wmape, round(SUM(abs(y - f3)) / COUNT(*), 4) AS mae,
  round(CASE WHEN SUM(abs(y)) > 0 THEN (SUM(f3) - SUM(y)) / SUM(abs(y)) END, 6) AS bias FROM c JOIN actual a ON a.job_id = c.job_id AND a.sheet_name = c.sheet_name AND a.metric_name = c.metric_name AND a.ds = c.ds
WHERE y IS NOT NULL AND f3 IS NOT NULL AND EXISTS (SELECT 1 FROM stored_edits e WHERE e.job_id = c.job_id AND e.sheet_name = c.sheet_name) GROUP BY 1, 2, 3""")
def k10(spark: SparkSession, sf: str) -> DataFrame:
    points = _actuals(spark, sf).where("y is not null").select(*RUN, "ds", F.col("y").alias("actual"))
    s = R.adjusted_scores(_records(spark, sf), stored_edits(spark, sf), points)
    return s.select(*RUN, "matched_points", F.round("wmape", 6).alias("wmape"), F.round("mae", 4).alias("mae"), F.round("bias", 6).alias("bias"))


@query("k11_candidate_uploads", ctes("jobs", "uploads", "upload_columns", "job_metrics") + """
SELECT job_id, upload_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY uploaded_at DESC, upload_id DESC) AS place FROM (
  SELECT DISTINCT m.job_id, u.upload_id, u.created_at AS uploaded_at FROM job_metrics m JOIN jobs j ON j.id = m.job_id JOIN upload_columns c ON c.column_name = m.metric JOIN uploads u ON u.upload_id = c.upload_id
  WHERE u.user_id = j.user_id AND u.created_at > j.created_at AND u.upload_id <> j.id * 10 + 1) x) t WHERE place <= 20""")
def k11(spark: SparkSession, sf: str) -> DataFrame:
    jobs = load(spark, sf, "jobs").select(F.col("id").alias("job_id"), "user_id", "created_at", (F.col("id") * 10 + 1).alias("input_upload_id"))
    return R.candidate_uploads(jobs, load(spark, sf, "job_metrics"), load(spark, sf, "uploads"), load(spark, sf, "upload_columns")).select("job_id", "upload_id", "place")


# ---- run history ---------------------------------------------------------------
HIST = ctes("jobs", "model_runs")
CHAMPS = "SELECT * FROM model_runs WHERE is_champion"
TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS place FROM {src} {where}) t WHERE place <= {k}"


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return load(spark, sf, "jobs"), load(spark, sf, "model_runs")


@query("l01_status_counts", ctes("jobs") + "SELECT user_id, CAST(COUNT(*) AS BIGINT) AS total_runs, " + ", ".join(
    f"CAST(COUNT(CASE WHEN status = '{s}' THEN 1 END) AS BIGINT) AS {s}" for s in H.STATUSES) + ", MAX(created_at) AS last_run_at FROM jobs GROUP BY 1")
def l01(spark: SparkSession, sf: str) -> DataFrame:
    return H.status_summary(load(spark, sf, "jobs")).drop("success_rate")


@query("l02_success_rate", ctes("jobs") + """SELECT user_id, round(COUNT(CASE WHEN status = 'success' THEN 1 END) / nullif(COUNT(CASE WHEN status IN ('success', 'failed') THEN 1 END), 0), 6) AS success_rate FROM jobs GROUP BY 1""")
def l02(spark: SparkSession, sf: str) -> DataFrame:
    return H.status_summary(load(spark, sf, "jobs")).select("user_id", F.round("success_rate", 6).alias("success_rate"))


@query("l03_robust_median", ctes("model_runs") + """SELECT job_id, round(median(CASE WHEN isfinite(wmape) THEN wmape END), 6) AS wmape FROM model_runs WHERE is_champion GROUP BY 1 HAVING COUNT(CASE WHEN isfinite(wmape) THEN 1 END) > 0""")
def l03(spark: SparkSession, sf: str) -> DataFrame:
    return H.run_medians(load(spark, sf, "model_runs").where("is_champion")).withColumn("wmape", F.round("wmape", 6))


@query("l04_recent_runs", HIST.rstrip() + f", ch AS ({CHAMPS}), top AS ({TOP.format(src='jobs', where='', k=5)})\n" + """
SELECT t.user_id, CAST(t.place AS INT) AS place, t.id AS job_id, t.name, t.file_name, t.status, t.created_at, m.champion AS champion_model, CAST(coalesce(m.n, 0) AS BIGINT) AS metric_count, round(m.med, 6) AS wmape
FROM top t LEFT JOIN (SELECT job_id, arg_min(model_name, concat(coalesce(sheet_name, ''), '|', coalesce(metric_name, ''), '|', lpad(CAST(id AS STRING), 20, '0'))) AS champion, COUNT(*) AS n, median(CASE WHEN isfinite(wmape) THEN wmape END) AS med FROM ch GROUP BY 1) m ON m.job_id = t.id""")
def l04(spark: SparkSession, sf: str) -> DataFrame:
    return H.recent_runs(*_history(spark, sf)).withColumn("wmape", F.round("wmape", 6))


TREND = f"SELECT job_id, median(wmape) AS wmape FROM (SELECT job_id, CASE WHEN isfinite(wmape) THEN wmape END AS wmape FROM ch WHERE wmape IS NOT NULL) c WHERE wmape IS NOT NULL GROUP BY 1"
TREND_CTES = HIST.rstrip() + f", ch AS ({CHAMPS}), done AS (SELECT * FROM jobs WHERE status = 'success' AND id IN (SELECT job_id FROM ch WHERE wmape IS NOT NULL)), top AS ({TOP.format(src='done', where='', k=20)}), med AS ({TREND}), trend AS (SELECT t.user_id, t.id AS job_id, t.created_at, m.wmape FROM top t JOIN med m ON m.job_id = t.id)\n"


@query("l05_accuracy_trend", TREND_CTES + "SELECT user_id, job_id, created_at, round(wmape, 6) AS wmape, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at, job_id) AS INT) AS position FROM trend")
def l05(spark: SparkSession, sf: str) -> DataFrame:
    return H.accuracy_trend(*_history(spark, sf)).withColumn("wmape", F.round("wmape", 6))


@query("l05b_trend_headline", TREND_CTES + "SELECT user_id, round(median(wmape), 6) AS median_wmape FROM trend GROUP BY 1")
def l05b(spark: SparkSession, sf: str) -> DataFrame:
    return H.trend_headline(H.accuracy_trend(*_history(spark, sf))).withColumn("median_wmape", F.round("median_wmape", 6))


@query("l06_demand_mix", HIST + """
SELECT user_id, CASE WHEN demand_type IN ('Smooth', 'Erratic', 'Intermittent', 'Lumpy') THEN demand_type ELSE 'unclassified' END AS demand_type, CAST(COUNT(*) AS BIGINT) AS series FROM (
  SELECT DISTINCT ON (j.user_id, coalesce(j.file_name, CAST(j.id AS STRING)), sheet_name, metric_name) j.user_id, demand_type FROM model_runs m JOIN jobs j ON j.id = m.job_id WHERE is_champion
  ORDER BY j.user_id, coalesce(j.file_name, CAST(j.id AS STRING)), sheet_name, metric_name, j.created_at DESC, j.id DESC, m.id DESC) d GROUP BY 1, 2""")
def l06(spark: SparkSession, sf: str) -> DataFrame:
    return H.demand_mix(*_history(spark, sf))


@query("l07_active_runs", ctes("jobs", top=TOP.format(src="jobs", where="WHERE status IN ('pending', 'running')", k=5)) + "SELECT user_id, CAST(place AS INT) AS place, id AS job_id, status, created_at FROM top")
def l07(spark: SparkSession, sf: str) -> DataFrame:
    return H.active_runs(load(spark, sf, "jobs")).drop("started_at")


TIMED = ctes("jobs", top=TOP.format(src="jobs", where="WHERE status = 'success' AND completed_at >= started_at", k=20), d="SELECT user_id, id, date_diff('second', started_at, completed_at) AS secs FROM top")


@query("l08_run_time", TIMED + "SELECT user_id, round(median(secs), 2) AS median_run_seconds FROM d GROUP BY 1")
def l08(spark: SparkSession, sf: str) -> DataFrame:
    return H.run_time(load(spark, sf, "jobs")).withColumn("median_run_seconds", F.round("median_run_seconds", 2))


@query("l08b_slowest_runs", TIMED + "SELECT user_id, CAST(place AS INT) AS place, id AS job_id, CAST(secs AS DOUBLE) AS duration_seconds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY secs DESC, id) AS place FROM d) t WHERE place <= 3")
def l08b(spark: SparkSession, sf: str) -> DataFrame:
    return H.slowest_runs(load(spark, sf, "jobs"))


WINS = HIST.rstrip() + ", w AS (SELECT user_id, model_name, COUNT(*) AS wins, row_number() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC, model_name) AS place, COUNT(*) OVER (PARTITION BY user_id) AS models FROM model_runs m JOIN jobs j ON j.id = m.job_id WHERE is_champion AND model_name IS NOT NULL GROUP BY 1, 2)\n"


@query("l09_model_wins", WINS + "SELECT user_id, model_name, CAST(wins AS BIGINT) AS wins, CAST(place AS INT) AS place FROM w")
def l09(spark: SparkSession, sf: str) -> DataFrame:
    return H.model_wins(*_history(spark, sf))


@query("l10_top_models_and_other", WINS + """SELECT user_id, CASE WHEN models > 6 AND place >= 6 THEN concat('Other (', CAST(models - 5 AS STRING), ')') ELSE model_name END AS label, models > 6 AND place >= 6 AS is_other,
  CAST(SUM(wins) AS BIGINT) AS wins, CAST(MIN(place) AS INT) AS place FROM w GROUP BY 1, 2, 3""")
def l10(spark: SparkSession, sf: str) -> DataFrame:
    return H.fold_wins(H.model_wins(*_history(spark, sf)))


@query("l11_realized_headline", ctes("evaluations", n="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, job_id, sheet_name, metric_name ORDER BY created_at DESC, id DESC) AS rn FROM evaluations) t WHERE rn = 1 AND matched_points > 0",
       r="SELECT user_id, job_id, median(wmape) AS wmape FROM n GROUP BY 1, 2") + "SELECT user_id, round(median(wmape), 6) AS realized_wmape, CAST(COUNT(wmape) AS BIGINT) AS realized_runs FROM r GROUP BY 1")
def l11(spark: SparkSession, sf: str) -> DataFrame:
    return H.realized_headline(load(spark, sf, "evaluations")).withColumn("realized_wmape", F.round("realized_wmape", 6))


@query("l12_history_page", HIST.rstrip() + f", top AS ({TOP.format(src='jobs', where='', k=50)})\n" + """
SELECT t.user_id, CAST(n.total AS BIGINT) AS total, CAST(t.place AS INT) AS place, t.id AS job_id, t.status, t.created_at, m.sheet_name, m.metric_name, m.model_name, CASE WHEN isfinite(m.wmape) THEN round(m.wmape, 6) END AS wmape
FROM top t JOIN (SELECT user_id, COUNT(*) AS total FROM jobs GROUP BY 1) n ON n.user_id = t.user_id LEFT JOIN model_runs m ON m.job_id = t.id AND m.is_champion WHERE t.place > 20""")
def l12(spark: SparkSession, sf: str) -> DataFrame:
    from seriesloom.functions.rules import finite
    return H.history_page(*_history(spark, sf), limit=30, offset=20).withColumn("wmape", F.round(finite(F.col("wmape")), 6))
