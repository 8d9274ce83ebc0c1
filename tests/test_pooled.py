"""Trees, ridge and recursive forecasts over all series, against brute force and by their effects."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import challengers as C, pooled as PO, trees as T

SF = "/root/testdata/sf0.001"
START = dt.date(2022, 1, 3)


@pytest.fixture(scope="module")
def noisy(spark):
    """Targets whose spread grows with x."""
    rng = np.random.default_rng(1)
    x, z = rng.uniform(0, 10, 6000), rng.integers(0, 4, 6000).astype(float)
    y = 2 * x + 3 * z + rng.exponential(1 + x)
    return spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "w": rng.normal(size=6000), "y": y})).repartition(4), x, z, y


def matrix(frame, features):
    pdf = frame.select("y", *features).toPandas()
    return pdf[list(features)].to_numpy(float), pdf["y"].to_numpy()


def test_boosting_puts_the_share_of_targets_below(noisy):
    frame, *_ = noisy
    for q, trees in ((0.25, 100), (0.75, 300)):
        model = T.boost(frame, ["x", "z", "w"], q, trees=trees, depth=4, least=20, share=0.7)
        x, y = matrix(frame, ["x", "z", "w"])
        p = model.predict(x)
        assert len(model.roots) == trees and abs(np.mean(y <= p) - q) < 0.02
        for low in (0, 3, 6):  # along x too, where the spread differs
            some = (x[:, 0] >= low) & (x[:, 0] < low + 3)
            assert abs(np.mean(y[some] <= p[some]) - q) < 0.08
        loss = lambda f: np.maximum(q * (y - f), (q - 1) * (y - f)).mean()
        assert loss(p) < 0.8 * loss(np.quantile(y, q))
    assert model.importance[0] > model.importance[2]


def test_one_round_of_boosting_equals_brute_force(spark):
    """One tree of one cut: the cut with the greatest gain of gradient sums, leaves at residual quantiles."""
    x = np.arange(40.0)
    y = np.where(x < 13, 1.0, 5.0) + x / 1000
    frame = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    model = T.boost(frame, ["x"], 0.5, trees=1, depth=1, leaves=2, abreast=1, least=5, share=1.0, shrink=1.0)
    start = float(np.percentile(y, 50))
    below = (y < start).astype(float)
    gains = {k: sum((0.5 * len(s) - s.sum()) ** 2 / len(s) for s in (below[:k], below[k:])) for k in range(5, 36)}
    best = max(gains.values())
    p = model.predict(x[:, None])
    cut = int((np.diff(p) != 0).argmax()) + 1
    assert gains[cut] == pytest.approx(best)
    assert p[0] == pytest.approx(np.median(y[:cut]), abs=0.1) and p[-1] == pytest.approx(np.median(y[cut:]), abs=0.1)


def test_random_trees_fit_and_differ(noisy):
    frame, *_ = noisy
    model = T.extra_trees(frame, ["x", "z", "w"], trees=40, depth=12, leaves=256, share=1.0)
    x, y = matrix(frame, ["x", "z", "w"])
    truth = 2 * x[:, 0] + 3 * x[:, 1] + 1 + x[:, 0]
    assert np.sqrt(np.mean((model.predict(x) - truth) ** 2)) < 0.35 * truth.std()
    assert len({tuple(model.cut[model.cut < 255][k::97]) for k in range(3)}) == 3
    leaf = list(model.leaves(model.binned(x)))
    for t in (0, 17):  # every leaf holds the mean of its rows, and no cut leaves fewer than the least
        for k in np.unique(leaf[t]):
            here = leaf[t] == k
            assert here.sum() >= len(y) // 256 and model.value[k] == pytest.approx(y[here].mean())
    first = T.extra_trees(frame, ["x", "z", "w"], trees=5, depth=1, leaves=256, share=1.0)
    assert len(np.unique(first.cut[:5])) > 1  # the roots' cuts are random, not the best ones


def test_empty_and_constant_frames(spark):
    none = spark.createDataFrame([], "x double, y double")
    assert T.boost(none, ["x"], 0.5).predict(np.ones((2, 1))).tolist() == [0.0, 0.0]
    assert T.extra_trees(none, ["x"]).predict(np.ones((2, 1))).tolist() == [0.0, 0.0]
    flat = spark.createDataFrame([(1.0, 3.0)] * 50 + [(None, 3.0)] * 50, "x double, y double")
    for model in (T.boost(flat, ["x"], 0.5, trees=10), T.extra_trees(flat, ["x"], trees=5)):
        assert model.predict(np.array([[1.0], [np.nan]])) == pytest.approx([3.0, 3.0], abs=1e-3)  # residual bins
    weights, intercept = PO.ridge(flat.fillna(1.0), ["x"])
    assert weights.tolist() == [0.0] and intercept == pytest.approx(3.0)


def test_ridge_solves_the_normal_equations(noisy):
    frame, *_ = noisy
    names = ["x", "z", "w"]
    weights, intercept = PO.ridge(frame, names, alpha=7.0)
    x, y = matrix(frame, names)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w = np.linalg.solve(z.T @ z + 7.0 * np.eye(3), z.T @ (y - y.mean()))
    assert weights == pytest.approx(w / x.std(axis=0)) and intercept == pytest.approx(y.mean() - (w / x.std(axis=0)) @ x.mean(axis=0))


def series_frame(spark, values, kind=None):
    rows = [(k, START + dt.timedelta(i), float(v)) for k, ys in values.items() for i, v in enumerate(ys)]
    df = spark.createDataFrame(rows, "series_id string, ds date, y double")
    return df if kind is None else df.withColumn("kind", F.lit(kind))


def test_rolling_equals_one_step_after_the_other(spark):
    """The one-pass recursion against rows made by the Column form, a day at a time, with fixed weights."""
    rng = np.random.default_rng(3)
    values = {"a": rng.uniform(5, 9, 60), "b": rng.uniform(0, 2, 31), "new": rng.uniform(1, 2, 9)}
    rows = series_frame(spark, values, "future")
    fitted = PO.Fitted("line", PO.FEATURES, weights=rng.normal(size=len(PO.FEATURES)) * 0.02, intercept=0.4)
    scale = rows.groupBy("series_id").agg(F.avg("y").alias("scale"))
    wanted = spark.createDataFrame([(k, "future", s, START + dt.timedelta(len(v) + s - 1)) for k, v in values.items() for s in range(1, 9)],
                                   "series_id string, kind string, step int, ds date")
    days = PO.known_days(PO.cyclical(PO.calendar(wanted)), PO.CALENDAR_FEATURES)
    got = {r["series_id"]: r["path"] for r in PO.rolled_paths(fitted, PO.start_states(rows, scale), days, PO.CALENDAR_FEATURES).collect()}
    states = {r["series_id"]: r for r in PO.start_states(rows, scale).collect()}
    for name, r in states.items():
        state, path = list(r["state"]), []
        for s in range(1, 9):
            one = spark.createDataFrame([(state, r["last_ds"] + dt.timedelta(s))], "state array<double>, day date")
            x = np.array(one.select(*PO.future_row(F.col("state"), F.col("day"))).first())
            p = max(float(x @ fitted.weights + fitted.intercept), 0.0)
            path.append(p * r["scale"])
            state = (state + [p])[-28:]
        assert got[name] == pytest.approx(path), name


# ---- challengers -----------------------------------------------------------------
def a_run(spark, values, days=200, horizon=14):
    views = series_frame(spark, values).withColumn("part", F.when(F.col("ds") < START + dt.timedelta(days - 30), "train").otherwise("test"))
    wanted = spark.createDataFrame([(k, "future", s, START + dt.timedelta(days + s - 1)) for k in values for s in range(1, horizon + 1)],
                                   "series_id string, kind string, step int, ds date")
    return views, wanted


def forecasts(challenge, name):
    out: dict = {}
    for r in challenge.forecast(name, challenge.facts.select("series_id")).orderBy("series_id", "step").collect():
        out.setdefault(r["series_id"], []).append(r["yhat"])
    return out


@pytest.fixture(scope="module")
def swing():
    rng = np.random.default_rng(4)
    t = np.arange(200)
    return {"a": 50 + 10 * np.sin(2 * np.pi * t / 7) + rng.normal(0, 1, 200), "b": 40 + 5 * np.cos(2 * np.pi * t / 5) + rng.normal(0, 4, 200)}


def test_design_equals_the_recursion_on_every_test_day(spark, swing):
    views, wanted = a_run(spark, swing)
    facts = C.series_facts(views)
    rows = {(r["series_id"], r["ds"]): r for r in C.design(views, facts, ["US"]).collect()}
    own = {r["series_id"]: r for r in facts.collect()}
    assert own["a"]["lags"] != own["b"]["lags"]
    for name, ys in swing.items():
        mask = np.zeros((1, C.STATE_DAYS), bool)
        mask[0, np.array(own[name]["lags"]) - 1] = True
        for at in (170, 180, 199):
            row = rows[(name, START + dt.timedelta(at))]
            state = np.array(ys[at - C.STATE_DAYS:at])[None] / own[name]["scale"]
            made = PO.history_columns(state, np.array([row["dow"] == 0]), mask)
            for f in C.PAST_FEATURES:
                assert made[f][0] == pytest.approx(row[f]), f
        assert all(row[f"lag_{k}"] == 0 for k in range(1, 41) if k not in own[name]["lags"])


def test_covariate_holiday_and_log_switch_change_a_forecast(spark, swing):
    rng = np.random.default_rng(5)
    push = rng.integers(0, 2, 200).astype(float)
    push[-1] = 1.0
    values = {k: v + 30 * push for k, v in swing.items()}
    views, wanted = a_run(spark, values)
    extra = spark.createDataFrame([(k, START + dt.timedelta(i), float(push[i])) for k in values for i in range(200)], "series_id string, ds date, promo double")
    plain, with_x = (C.Challenge(views, wanted, ["US"], covariates=x, screen=False) for x in (None, extra))
    a, b = forecasts(plain, "Ridge"), forecasts(with_x, "Ridge")
    assert np.mean(b["a"]) > np.mean(a["a"]) + 8  # its last value, 1, goes on

    days = [START + dt.timedelta(int(i)) for i in [*rng.choice(200, 25, replace=False), 200, 210]]  # no lag foretells them
    holidays = spark.createDataFrame([("US", d, "own") for d in days], "region string, holiday date, name string")
    lifted = {k: np.array([y + 40 * (START + dt.timedelta(i) in days) for i, y in enumerate(v)]) for k, v in swing.items()}
    views, wanted = a_run(spark, lifted)
    a, b = (forecasts(C.Challenge(views, wanted, ["US"], holidays_extra=h, screen=False), "Ridge") for h in (None, holidays))
    assert b["a"][0] - a["a"][0] > 15 and b["a"][10] - a["a"][10] > 15  # days 200 and 210

    peaks = {"a": np.where(np.arange(200) % 29 == 0, 900.0, 5.0 + np.arange(200) % 7), "b": swing["b"]}
    views, wanted = a_run(spark, peaks)
    on = C.Challenge(views, wanted, ["US"], screen=False)
    assert {r["series_id"]: r["use_log"] for r in on.facts.collect()} == {"a": True, "b": False}
    logged = forecasts(on, "Ridge")
    on.facts = on.facts.withColumn("use_log", F.lit(False))
    on.states = on.states.withColumn("use_log", F.lit(False)).withColumn("target_scale", F.col("scale"))
    on.frame = on.frame.withColumn("target", F.col("y"))
    assert abs(np.mean(forecasts(on, "Ridge")["a"]) - np.mean(logged["a"])) > 5


def test_challenger_is_refitted_on_all_days(spark, swing):
    jump = {k: np.concatenate([v[:170], v[170:] + 100]) for k, v in swing.items()}  # only the test days show it
    views, wanted = a_run(spark, jump)
    challenge = C.Challenge(views, wanted, ["US"], screen=False)
    assert np.mean(forecasts(challenge, "Ridge")["a"]) > 90
    tested, fitted = challenge.test("Ridge")
    assert tested.count() == 60 and fitted.weights.tolist() != challenge._fit("Ridge", challenge.frame).weights.tolist()


@pytest.mark.parametrize("name", ["g10_pooled_boosting", "g11_pooled_forest", "g12_pooled_ridge"])
def test_registered_pooled_queries_run_whole(spark, name):
    """At their registered sizes: a row a series, kind and step."""
    from seriesloom.plans.all_queries import QUERIES
    rows = QUERIES[name](spark, SF).toPandas()
    assert rows.series_id.nunique() == 10 and rows.groupby(["series_id", "kind"]).step.max().max() >= 60
    assert (rows.groupby(["series_id", "kind"]).step.nunique() == rows.groupby(["series_id", "kind"]).size()).all()
    assert np.isfinite(rows.yhat).all() and (rows.yhat >= 0).all()
