"""Edits, realized accuracy, history, files and streams on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import edits as E, history as H, realized as R, typing as T
from seriesloom.sources import csvfiles, results, tables
from seriesloom.streaming import streams

D0 = dt.date(2025, 1, 1)
KEY = ["job_id", "sheet_name", "metric_name"]
K = "job_id int, sheet_name string, metric_name string"
EDIT = f"{K}, sequence_no int, operation_type string, value double, scale_pct double, min_value double, max_value double, date_from date, date_to date, days_of_week array<int>"


def records(spark, values, start=D0):
    rows = [(1, "s", "m", start + dt.timedelta(i), v, None, None, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"{K}, ds date, forecast double, train_actual double, test_actual double, test_prediction double")


def edit(seq, kind, **p):
    names = ("value", "scale_pct", "min_value", "max_value", "date_from", "date_to", "days_of_week")
    return (1, "s", "m", seq, kind, *[p.get(n) for n in names])


def test_replay_revert_and_export(spark):
    base = records(spark, [10.0, 20.0, None, 40.0, 50.0])  # Wednesday to Sunday
    stack = spark.createDataFrame([
        edit(1, "scale_range", scale_pct=120.0), edit(2, "clip_bounds", max_value=45.0), edit(3, "set_value_range", value=0.0, days_of_week=[5, 6], date_to=D0 + dt.timedelta(3))], EDIT)
    got = [r["edited_forecast"] for r in E.replay(base, stack).orderBy("ds").collect()]
    assert got == pytest.approx([12.0, 24.0, None, 0.0, 45.0])
    undone = [r["edited_forecast"] for r in E.replay(base, E.revert_latest(stack)).orderBy("ds").collect()]
    assert undone == pytest.approx([12.0, 24.0, None, 45.0, 45.0])
    touched = {(r["sequence_no"], r["ds"].day): r["forecast"] for r in E.affected_before(base, stack).collect()}
    assert touched[(3, 4)] == 45.0 and (3, 5) not in touched and touched[(2, 5)] == 60.0 and len(touched) == 9
    wide = results.export_frame(base, stack)
    assert wide.columns[-4:] == ["baseline_forecast", "op_1_scale_range", "op_2_clip_bounds", "op_3_set_value_range"]
    assert results.export_frame(base, stack.limit(0)).columns[-1] == "forecast"


def test_edit_validation(spark):
    cases = {
        '{"operation_type":"set_value_range","value":0,"date_from":null,"date_to":null,"days_of_week":[5,6]}': None,
        '```json\n{"operation_type":"scale_range","scale_pct":110}\n```': None, 'Here: {"operation_type":"clip_bounds","min_value":null,"max_value":500} done': None,
        '{"operation_type":"none"}': "not a forecast edit", '{"operation_type":"drop_table","value":1}': "unknown operation type", "{}": "unknown operation type",
        "make it bigger": "not valid JSON", '{"operation_type":"set_value_range","value":1,"days_of_week":[7]}': "days_of_week values must be 0-6",
        '{"operation_type":"clip_bounds","min_value":9,"max_value":1}': "max_value must be >= min_value", '{"operation_type":"scale_range"}': "scale_pct is required",
        '{"operation_type":"set_value_range","value":"many"}': "unreadable parameter", '{"operation_type":"set_value_range","value":1,"date_from":"someday"}': "unreadable parameter",
    }
    got = {r["raw_text"]: r for r in E.validate(spark.createDataFrame([(c,) for c in cases], "raw_text string")).collect()}
    for text, reason in cases.items():
        assert got[text]["rejected"] == reason and (got[text]["op"] is None) == (reason is not None), text


def compare(spark, actual: dict, forecast: dict):
    a = spark.createDataFrame([(1, D0 + dt.timedelta(i), None if v is None else float(v)) for i, v in actual.items()], "k int, ds date, y double")
    f = spark.createDataFrame([(1, D0 + dt.timedelta(i), float(v)) for i, v in forecast.items()], "k int, ds date, forecast double")
    return R.compare(f, a, ["k"]).collect()[0]


def test_scores_over_shared_days(spark):
    r = compare(spark, {0: 40.0, 1: 60.0}, {0: 50, 1: 45})
    assert [r[k] for k in ("matched_points", "mae", "actual_total", "forecast_total")] == [2, 12.5, 100, 95]
    assert (r["wmape"], r["bias"]) == (pytest.approx(0.25), pytest.approx(-0.05))
    six = compare(spark, dict(enumerate([12.0, 18, 25, 31, 40, 44])) | {-3: 5.0, 8: 5.0}, dict(enumerate([10, 20, 30, 30, 40, 50])))
    assert (six["status"], six["wmape"], six["mae"], six["bias"]) == ("complete", pytest.approx(16 / 170), pytest.approx(16 / 6), pytest.approx(10 / 170))


def test_what_cannot_be_scored(spark):
    unsold = compare(spark, {2: 0.0, 3: 0.0}, {2: 1, 3: 4})
    assert (unsold["wmape"], unsold["bias"], unsold["mae"]) == (None, None, 2.5)
    returned = compare(spark, {0: -3.0, 1: -5.0}, {0: 0, 1: 0})
    assert (returned["actual_total"], returned["wmape"], returned["status"]) == (-8, 1.0, "complete")
    assert compare(spark, {0: 5.0, 1: None, 2: None, 3: 8.0}, {0: 1, 1: 1, 2: 1, 3: 1})["matched_points"] == 2
    later = compare(spark, {30: 2.0}, {0: 9, 1: 9})
    assert (later["status"], later["mae"], later["points"]) == ("no_overlap", None, []) and later["actuals_last_date"] == D0 + dt.timedelta(30)
    some = compare(spark, {3: 7.0, 4: 9.0, 9: 2.0}, {2: 5, 3: 6, 4: 8})
    assert some["status"] == "partial" and [p["date"] for p in some["points"]] == [D0 + dt.timedelta(3), D0 + dt.timedelta(4)]


def test_last_forecast_of_a_day_stays(spark):
    rows = [(1, "s", "m", dt.datetime(2025, 1, 1, h), f) for h, f in ((0, 9.0), (12, 5.0), (18, None))]
    got = R.forecast_series(spark.createDataFrame(rows, f"{K}, ds timestamp, forecast double")).collect()
    assert [(r["ds"], r["forecast"]) for r in got] == [(D0, 5.0)]


def test_pairing_and_adjusted_scores(spark):
    j = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x"), (3, "x"), (3, "y")], "job_id int, job_sheet string")
    u = spark.createDataFrame([(1, "b"), (1, "c"), (2, "Sheet1"), (3, "Sheet1")], "job_id int, upload_sheet string")
    assert sorted(map(tuple, R.pair_sheets(j, u).collect())) == [(1, "b", "b"), (2, "x", "Sheet1")]
    base = records(spark, [100.0] * 10)
    points = base.select(*KEY, "ds", F.lit(200.0).alias("actual"))
    stack = spark.createDataFrame([edit(1, "set_value_range", value=200.0)], EDIT)
    assert R.adjusted_scores(base, stack, points).collect()[0]["wmape"] == 0.0
    assert R.adjusted_scores(base, stack.limit(0), points).count() == 0


def test_candidate_uploads_keep_the_newest_twenty(spark):
    jobs = spark.createDataFrame([(1, 7, 10, 999), (2, 7, 95, 999)], "job_id int, user_id int, created_at int, input_upload_id int")
    metrics = spark.createDataFrame([(1, "sales"), (1, "units"), (2, "units")], "job_id int, metric string")
    ups = [(i, 7, i) for i in range(100)] + [(999, 7, 500), (500, 8, 50)]
    uploads = spark.createDataFrame(ups, "upload_id int, user_id int, created_at int")
    columns = spark.createDataFrame([(i, "sales" if i % 2 else "units") for i, _, _ in ups], "upload_id int, column_name string")
    got: dict[int, list[int]] = {1: [], 2: []}
    for r in R.candidate_uploads(jobs, metrics, uploads, columns).orderBy("job_id", "place").collect():
        got[r["job_id"]].append(r["upload_id"])
    assert got == {1: list(range(99, 79, -1)), 2: [98, 96]}


def test_candidate_uploads_of_many_metrics_meet_as_lists(spark):
    ups = [(i, 7, i // 2) for i in range(60)]
    metrics = spark.createDataFrame([(1, c) for c in "abc"] + [(2, "b")], "job_id int, metric string")
    jobs = spark.createDataFrame([(1, 7, 3, 59), (2, 7, 28, None)], "job_id int, user_id int, created_at int, input_upload_id int")
    uploads = spark.createDataFrame([*ups, (59, 7, 29), (70, 7, None)], "upload_id int, user_id int, created_at int")
    columns = spark.createDataFrame([(i, c) for i in (*range(60), 70) for c in "abc" if (i + ord(c)) % 3], "upload_id int, column_name string")
    found = R.candidate_uploads(jobs, metrics, uploads, columns)
    got = {j: [r["upload_id"] for r in found.where(f"job_id = {j}").orderBy("place").collect()] for j in (1, 2)}
    assert got == {1: list(range(58, 38, -1)), 2: [i for i in (59, 58) if (i + ord("b")) % 3]}
    # only uploads are ranked row by row; a job's candidates are not
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Window [") for line in plan.splitlines()) == 1


def test_history(spark):
    at = dt.datetime(2026, 1, 1)
    jobs = spark.createDataFrame([(i, 1, s, f"run {i}", None if i == 3 else "f.csv", at + dt.timedelta(minutes=i), at, at + dt.timedelta(seconds=sec)) for i, s, sec in (
        (1, "success", 60), (2, "success", 180), (3, "failed", 10), (4, "running", 10), (5, "stopped", 10), (6, "success", -5))],
        "id int, user_id int, status string, name string, file_name string, created_at timestamp, started_at timestamp, completed_at timestamp")
    runs = spark.createDataFrame([(1, 1, "s", "a", "A", 0.1, "Smooth", True), (2, 1, "s", "b", "B", 0.3, "Lumpy", True), (3, 1, "s", "a", "C", 0.01, "Smooth", False),
                                  (4, 2, "s", "a", "B", 0.5, "Erratic", True), (5, 3, "s", "a", "B", None, "odd", True)],
                                 "id int, job_id int, sheet_name string, metric_name string, model_name string, wmape double, demand_type string, is_champion boolean")
    s = H.status_summary(jobs).collect()[0]
    assert (s["total_runs"], s["success"], s["pending"], s["success_rate"]) == (6, 3, 0, 0.75)
    recent = {r["job_id"]: (r["champion_model"], r["metric_count"], r["wmape"]) for r in H.recent_runs(jobs, runs).collect()}
    assert recent[2] == ("B", 1, 0.5) and recent[3] == ("B", 1, None) and recent[6] == (None, 0, None) and len(recent) == 5
    trend = H.accuracy_trend(jobs, runs)
    assert [(r["job_id"], pytest.approx(r["wmape"])) for r in trend.orderBy("position").collect()] == [(1, 0.2), (2, 0.5)]
    assert H.trend_headline(trend).collect()[0]["median_wmape"] == pytest.approx(0.35)
    assert {r["demand_type"]: r["series"] for r in H.demand_mix(jobs, runs).collect()} == {"Erratic": 1, "Lumpy": 1, "unclassified": 1}
    assert H.run_time(jobs).collect()[0]["median_run_seconds"] == 120 and [r["job_id"] for r in H.slowest_runs(jobs).orderBy("place").collect()] == [2, 1]
    assert [(r["model_name"], r["wins"]) for r in H.model_wins(jobs, runs).orderBy("place").collect()] == [("B", 3), ("A", 1)]
    wins = spark.createDataFrame([(1, f"m{i}", 10 - i, i + 1) for i in range(8)], "user_id int, model_name string, wins long, place int")
    assert [(r["label"], r["wins"]) for r in H.fold_wins(wins).orderBy("place").collect()][-1] == ("Other (3)", 5 + 4 + 3)
    assert H.fold_wins(wins.where("place <= 6")).where("is_other").count() == 0
    ev = spark.createDataFrame([(1, 1, 1, "s", "a", 5, 0.1, 1), (2, 1, 1, "s", "a", 0, None, 2), (3, 2, 1, "s", "a", 5, 0.4, 1)],
                               "id int, job_id int, user_id int, sheet_name string, metric_name string, matched_points int, wmape double, created_at int")
    r = H.realized_headline(ev).collect()[0]
    assert (r["realized_wmape"], r["realized_runs"]) == (0.4, 1)  # the newer empty check hides job 1's score


def test_date_column_and_sheets(spark):
    raw = spark.createDataFrame([("x", 5, "2024-01-01", 2001), ("y", 9000, "01/02/2024", 2002), ("z", 7, "soon", 2003), ("w", 8, "2024-01-04", 2004), ("v", 3, "3-Feb-2024", 2005)],
                                "name string, sales int, day string, season int")
    assert T.infer_date_column(raw) == "day" and T.infer_date_column(raw.drop("day")) == "season" and T.infer_date_column(raw.select("name", "sales")) is None
    assert T.infer_date_column(raw.withColumn("late", F.lit(D0))) == "late"
    with pytest.raises(ValueError, match="No sheet contains a date column"):
        tables.dataset_catalog({"s": raw.select("name", "sales")})
    kept = tables.dataset_catalog({"s": raw, "t": raw.select("name")}).collect()
    assert [(r["sheet"], r["row_count"], r["date_column"]) for r in kept] == [("s", 5, "day")]


def test_csv_encodings(spark, tmp_path):
    text = {"utf8.csv": ("name,y\ncafé,1\n", "utf-8"), "bom.csv": ("name,y\ncafé,2\n", "utf-8-sig"), "win.csv": ("name,y\n“café” – ok,3\n", "cp1252")}
    for name, (body, enc) in text.items():
        (tmp_path / name).write_bytes(body.encode(enc))
    (tmp_path / "latin.csv").write_bytes(b"name,y\ncaf\xe9 \x81,4\n")
    got = {r["y"]: r["name"] for r in csvfiles.read_csv(spark, [str(tmp_path / n) for n in (*text, "latin.csv")]).collect()}
    assert got == {"1": "café", "2": "café", "3": "“café” – ok", "4": "café \x81"}
    (tmp_path / "p.csv").write_text("date,qty,price\n1,7,200\n")
    (tmp_path / "q.csv").write_text("price,date\n300,2\n")
    rows = csvfiles.read_csv(spark, [str(tmp_path / "p.csv"), str(tmp_path / "q.csv")]).collect()
    assert sorted((r["date"], r["qty"], r["price"]) for r in rows) == [("1", "7", "200"), ("2", None, "300")]
    with pytest.raises(ValueError, match="Unsupported file type"):
        csvfiles.read_dataset(spark, {"a": "x.json"})


def test_results_store_and_trees(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(j, i, float(i)) for j in (1, 2, 3) for i in range(4)], "job_id int, i int, v double")
    results.write_results(rows, path, buckets=2)
    results.write_results(rows.where("job_id = 2 and i < 2").withColumn("v", F.lit(9.0)), path, buckets=2)
    assert sorted((r["job_id"], r["i"], r["v"]) for r in results.read_results(spark, path, 2, buckets=2).collect()) == [(2, 0, 9.0), (2, 1, 9.0)]
    assert spark.read.parquet(path).count() == 10
    trees = spark.createDataFrame([(1, '{"s":{"metrics":{"a":{"w":1},"b":3}}}'), (2, '{"s":{"a":{"w":2}},"t":5}'), (3, "not json"), (4, None)], "job_id int, result string")
    assert sorted((r["job_id"], r["sheet_name"], r["metric_name"]) for r in results.normalize_results(trees).collect()) == [(1, "s", "a"), (2, "s", "a")]


def test_streams_over_several_batches(spark, tmp_path):
    """A re-sent reading arrives in a later file; results equal the batch form."""
    schema = "series_id string, ds date, row_no int, y double"
    batches = [[("a", D0, 1, 10.0), ("a", D0 + dt.timedelta(1), 2, 20.0)], [("a", D0, 5, 11.0), ("b", D0, 1, 7.0)], [("a", D0, 3, 99.0), ("b", D0, 2, None)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.keep_last_stream(source, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    whole = spark.createDataFrame([r for rows in batches for r in rows], schema)
    got = spark.read.parquet(str(tmp_path / "t")).select("series_id", "ds", "y")
    want = streams.batch_keep_last(whole)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 3
    forecasts = spark.createDataFrame([("a", D0, 10.0), ("a", D0 + dt.timedelta(1), 25.0), ("b", D0, 7.0)], "series_id string, ds date, forecast double")
    streams.realized_stream(source, forecasts, str(tmp_path / "a"), str(tmp_path / "s"), str(tmp_path / "c2"), buckets=2).awaitTermination()
    scores = {r["series_id"]: r for r in spark.read.parquet(str(tmp_path / "s")).collect()}
    direct = {r["series_id"]: r for r in R.compare(forecasts, want, ["series_id"]).collect()}
    for k in ("a", "b"):
        assert [scores[k][f] for f in ("matched_points", "wmape", "status")] == [direct[k][f] for f in ("matched_points", "wmape", "status")]
