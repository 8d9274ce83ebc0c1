"""Helpers that must neither fail nor grow beyond a task where tables grow."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np
from pyspark.sql import functions as F

from seriesloom.functions.spread import join_facts
from seriesloom.operators import models as G, prepare as P
from seriesloom.plans import inputs, model_queries
from seriesloom.streaming import streams


def days(spark, n: int, value: str, series: str = "'a'"):
    return spark.sql(f"select {series} as series_id, date_add(date'2024-01-01', cast(id as int)) as ds, cast({value} as double) as y from range({n})")


def test_salted_facts_are_broadcast_by_the_size_of_all_copies(spark, capsys):
    rows = spark.range(40000).select((F.col("id") % 3000).alias("k"), "id")
    facts = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")  # over one copy's estimate, under that of 16
    try:
        joined = join_facts(rows, facts, ["k"], ["id"])
        joined.explain()
        assert "BroadcastHashJoin" not in capsys.readouterr().out
        assert joined.where("v = 2 * k").count() == 40000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_constant_series_have_no_autocorrelation(spark):
    for value, n in (("5", 40), ("0.1", 3), ("case when id = 0 then 5 else 1 end", 40)):
        series = days(spark, n, value)
        assert P.lag1_autocorrelation(series).first().autocorr is None
        assert P.analyze_treatment(series).first().weekday_treatment in ("median", "recent_seasonal_median")
    assert abs(P.lag1_autocorrelation(days(spark, 40, "id")).first().autocorr - 1) < 1e-12


def test_daily_series_lie_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    """Tasks follow the number of readings, and a series lies in one of them."""
    spark.range(4000).selectExpr("id as l_orderkey", "id % 90 as l_suppkey", "timestamp'2024-01-01' + make_dt_interval(cast(id % 70 as int)) as l_shipdate",
                                 "cast(id % 50 as double) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(inputs, "READINGS_A_TASK", 100)
    series = inputs.daily_series(spark, str(tmp_path))
    held = series.withColumn("task", F.spark_partition_id()).groupBy("series_id").agg(F.countDistinct("task").alias("tasks"), F.min("task").alias("task"))
    assert series.rdd.getNumPartitions() == 40
    found = held.collect()
    assert {r.tasks for r in found} == {1} and len({r.task for r in found}) > 20
    assert series.exceptAll(inputs.load(spark, str(tmp_path), "supplier_daily")).isEmpty()


def test_in_order_filling_sees_earlier_fills_and_takes_no_pass_a_gap(spark):
    """Every gap against the rule on the values so far; 30,000 gaps take no pass over the series each."""
    rng = np.random.default_rng(3)
    for weekday in ("zero", "median", "ffill", "recent_seasonal_median", "yearly_seasonal_median"):
        values = rng.normal(20, 9, 700)
        values[rng.random(700) < 0.7] = np.nan
        dow = [(k + 2) % 7 for k in range(700)]
        got, y = P.filled_in_order(values, dow, weekday, "zero"), values.copy()
        for i in np.flatnonzero(np.isnan(values)):
            near = y[max(0, i - 90):i]
            same = near[[d == dow[i] for d in dow[max(0, i - 90):i]]]
            recent = np.median(same if len(same) else near) if i else np.nanmedian(y[:30])
            rule = "zero" if dow[i] >= 5 else weekday
            y[i] = {"zero": 0.0, "yearly_seasonal_median": np.median(y[i - 372:i - 357]) if i >= 372 else recent,
                    "recent_seasonal_median": recent}.get(rule, np.nanmedian(y))
        assert got == y.tolist(), weekday
    long = np.where(np.arange(40_000) % 4 == 0, 1.0, np.nan)
    began = time.process_time()
    P.filled_in_order(long, [0] * 40_000, "median", "median")
    assert time.process_time() - began < 2.0  # some 5 s when each gap sorted the whole series


def test_grid_of_days_and_fold_keep_types_and_nulls(spark):
    rows = spark.sql("select cast(null as string) as series_id, date'2024-02-27' as ds, 1.0D as y union all select null, date'2024-03-02', 2.0D union all select 's', null, 4.0D")
    grid = P.daily_grid(rows)
    assert [str(r.ds) for r in grid.orderBy("ds").collect()] == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"]
    assert dict(grid.dtypes)["ds"] == "date"
    filled = P.impute_in_order(rows.selectExpr("*", "'ffill' as weekday_treatment", "'zero' as weekend_treatment"))
    assert [r.y for r in filled.orderBy("ds").collect()] == [1.0, 1.0, 1.0, 1.0, 2.0]


def test_streamed_scores_work_the_forecasts_out_once(spark, tmp_path):
    """Three batches read forecasts that were stored when the stream started."""
    asked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            asked.add(len(pdf))
            yield pdf
    days = spark.sql("select concat('s', cast(id % 5 as string)) as series_id, date_add(date'2024-01-01', cast(id as int)) as ds, cast(id as double) as forecast from range(30)")
    forecasts = days.repartition(1).mapInPandas(seen, days.schema)
    actuals = spark.sql("select concat('s', cast(id % 5 as string)) as series_id, date_add(date'2024-01-01', cast(id as int)) as ds, id as row_no, cast(id + 1 as double) as y from range(30)")
    actuals.repartition(3, "row_no").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(actuals.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.realized_stream(source, forecasts, str(tmp_path / "a"), str(tmp_path / "s"), str(tmp_path / "c"), buckets=2).awaitTermination()
    scores = spark.read.parquet(str(tmp_path / "s")).collect()
    assert sorted((r.series_id, r.matched_points, r.mae) for r in scores) == [(f"s{k}", 6, 1.0) for k in range(5)]
    assert asked.value == 30


def test_fitting_rows_lie_in_tasks_whose_number_follows_the_input(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id as l_orderkey", "id % 90 as l_suppkey", "timestamp'2024-01-01' + make_dt_interval(cast(id % 71 as int)) as l_shipdate",
                                 "cast(id % 50 as double) as l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(inputs, "READINGS_A_TASK", 100)
    for made in (model_queries.setup, model_queries.pooled_setup):
        rows = made(spark, str(tmp_path))[1]
        assert rows.rdd.getNumPartitions() == 40
        placed = rows.withColumn("task", F.spark_partition_id()).groupBy("series_id").agg(F.countDistinct("task").alias("tasks")).collect()
        assert len(placed) == 90 and {r.tasks for r in placed} == {1}


def test_croston_sums_a_fit_from_one_row_of_its_values(spark, capsys):
    """Against a plain loop, and without the sorts of windows over all days."""
    rng = np.random.default_rng(7)
    series = {f"s{k}": np.where(rng.random(n) < 0.3, rng.integers(1, 9, n), 0).astype(float).tolist() for k, n in enumerate((1, 2, 5, 60, 400))}
    series |= {"none": [0.0] * 5, "null": [None, 3.0, None, None, 4.0, 0.0, 2.0], "nan": [1.0, float("nan"), 2.0]}
    rows = spark.createDataFrame([(s, k, dt.date(2024, 1, 1) + dt.timedelta(days=i), y) for s, ys in series.items() for k in ("test", "future")
                                  for i, y in reversed(list(enumerate(ys)))], "series_id string, kind string, ds date, y double")
    for alpha in (0.1, 0.4):
        fitted = G.fit_croston(rows, alpha)
        got = {(r.series_id, r.kind): r.level for r in fitted.collect()}
        assert len(got) == 2 * len(series)
        for s, ys in series.items():
            at = [i for i, y in enumerate(ys) if y is not None and not y <= 0]
            if not at:
                assert got[s, "test"] == got[s, "future"] == 0.0
                continue
            size, gaps = ys[at[0]], np.diff(at)
            for i in at[1:]:
                size = alpha * ys[i] + (1 - alpha) * size
            interval = gaps.mean() if len(gaps) else 1.0
            for g in gaps[1:]:
                interval = alpha * g + (1 - alpha) * interval
            np.testing.assert_allclose([got[s, "test"], got[s, "future"]], size / max(interval, 1.0), rtol=1e-9)
    G.fit_croston(rows).explain()
    assert "Window" not in capsys.readouterr().out
    assert G.fit_croston(rows.where("false")).count() == 0
