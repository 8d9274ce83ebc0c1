"""Every report code, on series whose answer is known."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import quality as Q

START = dt.datetime(2024, 1, 1)


def daily(n: int, value=lambda i: 100 + 10 * math.sin(i / 3), step: dt.timedelta = dt.timedelta(days=1)) -> list[tuple]:
    return [(str(START + i * step), None if value(i) is None else str(value(i))) for i in range(n)]


def changed(rows: list[tuple], edits: dict[int, tuple]) -> list[tuple]:
    return [tuple(new if new is not ... else old for new, old in zip(edits[i], row)) if i in edits else row for i, row in enumerate(rows)]


SERIES = {
    "n29": daily(29), "n30": daily(30), "every3rd": daily(40, lambda i: None if i % 3 == 0 else i), "n20": daily(20),
    "baddates": changed(daily(60), {3: ("garbage", ...), 4: ("soon", ...)}), "words": changed(daily(60), {1: (..., "n/a"), 2: (..., "n/a"), 3: (..., "n/a"), 4: (..., None)}),
    "repeats": daily(60) + daily(4, lambda i: 7.0), "clean": daily(200), "weekly": daily(60, step=dt.timedelta(days=7)), "hourly": daily(960, step=dt.timedelta(hours=1)),
    "gap30": [r for i, r in enumerate(daily(200)) if not 50 <= i < 80], "gap10": [r for i, r in enumerate(daily(200)) if not 50 <= i < 60],
    "negative": daily(60, lambda i: -3.0 if i == 30 else 50.0), "spike": daily(200, lambda i: 10000.0 if i == 100 else 100 + i % 7),
    "tails": daily(200, lambda i: 200.0 if i % 40 == 0 else 0.0 if i % 40 == 20 else 100 + (i % 3)), "flat": daily(60, lambda i: 5.0), "n100": daily(100),
    "quiet": daily(200, lambda i: 10.0 if i < 170 else 0.0), "n120": daily(120),
}


@pytest.fixture(scope="module")
def report(spark):
    rows = [(name, i, ds, y) for name, rows in SERIES.items() for i, (ds, y) in enumerate(rows)]
    readings = spark.createDataFrame(rows, "series_id string, row_no long, ds_raw string, y_raw string")
    return {r["series_id"]: r for r in Q.quality_report(readings, 30, 30).collect()}


def test_codes(report):
    got = {name: [i["code"] for i in r["issues"]] for name, r in report.items()}
    assert got["n29"] == ["insufficient_history"] and "insufficient_history" not in got["n30"]
    assert got["every3rd"] == ["insufficient_history"] and report["every3rd"]["usable_points"] == 26
    assert report["n20"]["span_days"] == 19 and report["n20"]["test_split_size"] == 0
    assert report["baddates"]["unparseable_dates"] == 2 and report["words"]["non_numeric_values"] == 3
    assert report["repeats"]["duplicate_timestamps"] == 4
    assert got["clean"] == []
    assert "non_daily_frequency" in got["weekly"] and "date_gaps" not in got["weekly"]
    assert report["weekly"]["imputed_share"] == pytest.approx(6 / 7, abs=0.01)
    assert "one reading per day" in " ".join(i["message"] for i in report["hourly"]["issues"])
    assert "date_gaps" in got["gap30"] and report["gap30"]["imputed_share"] == pytest.approx(0.15) and "date_gaps" not in got["gap10"]
    assert report["negative"]["negative_values"] == 1
    assert "will be clipped" in " ".join(i["message"] for i in report["spike"]["issues"])
    assert "left as-is" in " ".join(i["message"] for i in report["tails"]["issues"])
    assert report["flat"]["outliers"] == 0
    assert "sparse_test_window" in got["quiet"] and report["quiet"]["test_split_size"] == 30
    assert "short_history" in got["baddates"] and "short_history" not in got["n120"]


def test_horizon_cap(spark):
    rows = [("n100", i, ds, y) for i, (ds, y) in enumerate(SERIES["n100"])]
    readings = spark.createDataFrame(rows, "series_id string, row_no long, ds_raw string, y_raw string")
    capped = Q.quality_report(readings, 60, 30).collect()[0]
    assert capped["effective_horizon"] == 30 and "horizon_capped" in [i["code"] for i in capped["issues"]]


def test_gate(spark):
    none = spark.createDataFrame([], "code string, severity string, message string")
    rows = [(n, i, ds, y) for n in ("n29", "clean") for i, (ds, y) in enumerate(SERIES[n])]
    readings = spark.createDataFrame(rows, "series_id string, row_no long, ds_raw string, y_raw string")
    report = Q.quality_report(readings, 30, 30)
    assert Q.report_gate(report, none).collect()[0]["has_blocking"] is True
    assert Q.report_gate(report.where("series_id = 'clean'"), none).collect()[0]["has_blocking"] is False
    assert Q.report_gate(report.limit(0), none).collect()[0]["has_blocking"] is True
    groups = Q.group_issues(report, none.unionByName(spark.createDataFrame([("c", "warning", "m")], none.schema))).collect()
    assert {(g["severity"], g["label"]): g["issues"] for g in groups} == {("blocking", "n29"): 1, ("warning", None): 1}


def test_message_names_the_metric_where_there_is_one(spark):
    rows = [("words", i, ds, y) for i, (ds, y) in enumerate(SERIES["words"])]
    readings = spark.createDataFrame(rows, "series_id string, row_no long, ds_raw string, y_raw string")
    profile = Q.series_profile(readings, 30, 30).withColumn("metric", F.lit("sales"))
    (r,) = Q.series_issues(profile, 30).collect()
    assert [i["message"] for i in r["issues"] if i["code"] == "non_numeric_values"] == ["3 values in 'sales' aren't numbers and will be treated as missing."]
