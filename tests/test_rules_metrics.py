"""Rule tables and metric cases with hand-computed results."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from seriesloom.functions import rules
from seriesloom.operators import demand as D, metrics as M, select as S

# (value, setting, result): one below, on and one above the places where a rule changes, worked out by hand.
HOLDOUT = [(10, 3, 7), (39, 20, 7), (40, 20, 8), (44, 20, 8), (94, 20, 18), (95, 20, 19), (105, 20, 20), (106, 20, 20), (1245, 250, 249), (1255, 250, 250)]
HORIZON = [(5, 9, 9), (5, 40, 14), (48, 40, 14), (51, 40, 15), (54, 40, 16), (131, 40, 39), (137, 40, 40), (138, 40, 40), (4000, 9, 9)]
OVERLAP = [(2, 7), (22, 7), (25, 7), (28, 8), (31, 9), (44, 13), (201, 60)]


def test_holdout(spark):
    table = spark.createDataFrame(HOLDOUT, "n int, w int, want int")
    for window in {w for _, w, _ in HOLDOUT}:
        assert all(r["got"] == r["want"] for r in table.where(F.col("w") == window).withColumn("got", rules.holdout_size(F.col("n"), window)).collect())


def test_horizon(spark):
    table = spark.createDataFrame(HORIZON, "n int, h int, want int")
    for horizon in {h for _, h, _ in HORIZON}:
        assert all(r["got"] == r["want"] for r in table.where(F.col("h") == horizon).withColumn("got", rules.effective_horizon(F.col("n"), horizon)).collect())


def test_overlap(spark):
    table = spark.createDataFrame(OVERLAP, "n int, want int").withColumn("got", rules.min_test_overlap(F.col("n")))
    assert all(r["got"] == r["want"] for r in table.collect())


def pairs(spark, cases: dict[str, tuple[list, list]]):
    rows = [(name, dt.date(2024, 1, 1) + dt.timedelta(i), a, p) for name, (aa, pp) in cases.items() for i, (a, p) in enumerate(zip(aa, pp))]
    return spark.createDataFrame(rows, "series_id string, ds date, actual double, predicted double")


def test_metric_cases(spark):
    table = pairs(spark, {
        "same": ([3.0, 8.0, 5.0], [3.0, 8.0, 5.0]), "unsold": ([0.0] * 4, [2.0] * 4), "mixed": ([4.0, 6.0, 10.0], [5.0, 4.0, 13.0]),
        "far": ([1.0, 1.0], [500.0, 500.0]), "level": ([2.0, 4.0, 6.0, 8.0], [8.0] * 4), "hole": ([6.0, None, 2.0], [6.0, 3.0, 2.0]), "one": ([9.0], [3.0]),
    })
    std = table.select("series_id").distinct().withColumn("train_std", F.lit(1.0))
    got = {r["series_id"]: r for r in M.score_pairs(table, ["series_id"], std).collect()}
    assert [got["same"][k] for k in ("wmape", "rmse", "mape", "accuracy")] == [0, 0, 0, 100]
    assert got["unsold"]["mape"] is None and got["unsold"]["wmape"] > 1e6
    assert got["mixed"]["wmape"] == pytest.approx(0.3) and got["mixed"]["mae"] == pytest.approx(2) and got["mixed"]["rmse"] == pytest.approx((14 / 3) ** 0.5)
    assert got["far"]["accuracy"] == 0
    assert got["level"]["trend_error"] == pytest.approx(2 / 5)  # slopes 2 and 0, mean 5
    assert got["hole"]["wmape"] == pytest.approx(3 / 8) and got["hole"]["mae"] is None and got["hole"]["rmse"] is None
    assert got["one"]["trend_error"] == 0


def test_variance_penalty(spark):
    got = spark.createDataFrame([(1.0, 2.5), (1.0, 4.5), (0.0, 10.0), (1.0, None)], "t double, f double").select(
        M.variance_penalty(F.col("t"), F.col("f"))).collect()
    assert got[0][0] == 0 and got[1][0] == pytest.approx(2 / 3, abs=1e-6) and 0.99 < got[2][0] <= 1 and got[3][0] == 0


def test_coverage(spark):
    rows = [("in", 5.0, 0.0, 10.0), ("out", 50.0, 0.0, 1.0)]
    got = dict(M.coverage(spark.createDataFrame(rows, "k string, actual double, lower double, upper double"), ["k"]).collect())
    assert got == {"in": 1.0, "out": 0.0}


def test_quadrants(spark):
    rows = [("a", 1.0, 0.3), ("b", 1.0, 0.6), ("c", 2.0, 0.3), ("d", 2.0, 0.6), ("edge", 1.32, 0.49), ("never", None, 0.0)]
    got = {r["series_id"]: r["demand_type"] for r in D.classify(spark.createDataFrame(rows, "series_id string, adi double, cv2 double")).collect()}
    assert got == {"a": "Smooth", "b": "Erratic", "c": "Intermittent", "d": "Lumpy", "edge": "Lumpy", "never": "Intermittent"}


def test_routing_gates(spark):
    profile = spark.createDataFrame([("dense", "Smooth", False), ("rare", "Lumpy", True), ("short", "Smooth", False), ("tiny", "Erratic", False)],
                                    "series_id string, demand_type string, is_intermittent boolean")
    stats = spark.createDataFrame([("dense", 400, 100.0, 0.0, 0.2), ("rare", 400, 3.0, 0.6, 2.0), ("short", 89, 50.0, 0.0, 0.1), ("tiny", 400, 5.0, 0.0, 0.9)],
                                  "series_id string, n_points long, mean_val double, zero_ratio double, cv double")
    got: dict[str, list[str]] = {}
    for r in D.route_models(profile, stats).orderBy("series_id", "rank").collect():
        got.setdefault(r["series_id"], []).append(r["model"])
    assert got["dense"] == ["ExpSmoothing", "Prophet", "TBATS", "LightGBM", "HistGB", "SARIMAX", "Theta"]
    assert "short" not in got
    assert "Prophet" not in got["tiny"] and "SARIMAX" not in got["tiny"] and "LinearBaseline" in got["tiny"] and "Croston" not in got["tiny"]
    assert got["rare"][0] == "Croston" and "SARIMAX" not in got["rare"]


SCORE = "series_id string, model string, rank int, status string, composite_score double, wmape double"


def test_champion_and_revert(spark):
    rows = [("a", "X", 2, "completed", 0.2, 0.3), ("a", "Y", 1, "completed", 0.2, 0.4), ("a", "Z", 3, "skipped", 0.1, 0.1),
            ("b", "X", 1, "completed", 0.5, 0.0), ("c", "X", 1, "completed", 0.5, 0.6)]
    champs = S.select_champion(spark.createDataFrame(rows, SCORE)).select("series_id", "model", "wmape", "composite_score")
    assert {r[0]: r[1] for r in champs.collect()} == {"a": "Y", "b": "X", "c": "X"}
    base = spark.createDataFrame([("a", 0.4), ("b", 0.2), ("c", 0.5)], "series_id string, wmape double")
    got = {r["series_id"]: r["model"] for r in S.revert_to_baseline(champs, base).collect()}
    # an equal score keeps the champion, 0.0 is a real score, a better baseline wins
    assert got == {"a": "Y", "b": "X", "c": "Baseline_SMA"}


def test_challenger(spark):
    rows = [(1, 0.2, 0.18, 1.0, 1.0), (2, 0.2, 0.195, 1.0, 0.31), (3, 0.2, 0.195, 1.0, 0.2), (4, 0.2, 0.1, 1.0, 0.0), (5, None, 0.9, 0.0, 1.0)]
    got = {r["k"]: r["accepted"] for r in S.judge_challengers(spark.createDataFrame(
        rows, "k int, uni_wmape double, mv_wmape double, uni_std double, mv_std double")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_model_run_rows(spark):
    key = "job_id int, sheet_name string, metric_name string"
    scores = ", ".join(f"{s} double" for s in S.SCORES)
    inf = float("inf")
    board = spark.createDataFrame([
        (1, "s", "m", 1, "A", None, 0.1, 1.0, 2.0, 3.0, 90.0, 0.2, "completed", None), (1, "s", "m", 2, "B", "Univariate", inf, math.nan, 0.0, 3.0, 90.0, 0.2, "completed", None),
        (1, "s", "m", 3, "B", "Multivariate", 0.3, 1.0, 2.0, 3.0, 90.0, None, "failed", "boom"), (2, "s", "m", 1, "A", None, 0.1, 1.0, 2.0, 3.0, 90.0, 0.2, None, None)],
        f"{key}, position int, model_name string, stage string, {scores}, status string, error_message string")
    headline = spark.createDataFrame([
        (1, "s", "m", "B", False, 0.1, 1.0, 2.0, 3.0, 90.0, 0.2), (2, "s", "m", "Ensemble[A+B]", True, 0.05, 1.0, 2.0, 3.0, 95.0, 0.1),
        (3, "s", "m", "A", False, 0.1, 1.0, 2.0, 3.0, 90.0, 0.2), (4, "s", "m", None, False, None, None, None, None, None, None)],
        f"{key}, best_model string, is_multivariate boolean, {scores}")
    rows = S.model_runs(board, headline).collect()
    champions = {(r["job_id"], r["model_name"], r["stage"]) for r in rows if r["is_champion"]}
    assert champions == {(1, "B", "Univariate"), (2, "Ensemble[A+B]", "Multivariate"), (3, "A", "Univariate")}
    assert len(rows) == 3 + 2 + 1 + 1
    bad = next(r for r in rows if r["job_id"] == 1 and r["model_name"] == "B" and r["stage"] == "Univariate")
    assert bad["wmape"] is None and bad["mae"] is None and bad["mape"] == 0.0
    assert next(r for r in rows if r["job_id"] == 2 and r["model_name"] == "A")["status"] == "completed"


def test_records_and_boundary(spark):
    day = dt.date(2024, 1, 1)
    rows = [("s", day, "train_actual", 1.0), ("s", day, "train_raw", None), ("s", day + dt.timedelta(1), "test_actual", 2.0),
            ("s", day + dt.timedelta(1), "test_prediction", None), ("s", day + dt.timedelta(2), "forecast", 9.0), ("s", day + dt.timedelta(3), "forecast", None)]
    records = S.assemble_records(spark.createDataFrame(rows, "series_id string, ds date, kind string, value double"))
    got = {r["ds"].day: r for r in records.collect()}
    assert got[1]["train_raw"] is None and got[2]["test_prediction"] == 0.0 and got[4]["forecast"] == 0.0 and got[3]["test_actual"] is None
    assert S.boundary_date(records).collect()[0]["boundary_date"] == dt.date(2024, 1, 2)
