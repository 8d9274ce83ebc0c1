"""Run-history analytics, for every owner at once.

Input tables: jobs (id, user_id, status, name, file_name, created_at, started_at,
completed_at), model_runs (id, job_id, sheet_name, metric_name, model_name, wmape,
demand_type, is_champion), evaluations (id, job_id, user_id, sheet_name, metric_name,
matched_points, wmape, created_at). Top-k ranks have a fixed bound, which Spark
applies before the shuffle, so an owner with many runs costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import rules
from seriesloom.functions.spread import exact_percentiles, join_facts

# Report sizes and names.
STATUSES = ("success", "failed", "stopped", "running", "pending")
ACTIVE = ("pending", "running")
DEMAND_TYPES = ("Smooth", "Erratic", "Intermittent", "Lumpy")
RECENT_RUNS, TREND_RUNS, ACTIVE_RUNS, TIMED_RUNS, SLOWEST_RUNS, WIN_BARS = 5, 20, 5, 20, 3, 6


def _newest(jobs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.lit(k))


def _champions(model_runs: DataFrame) -> DataFrame:
    return model_runs.where("is_champion")


def success_rate(success: Column, failed: Column) -> Column:
    return F.try_divide(success.cast("double"), (success + failed).cast("double"))


def status_summary(jobs: DataFrame) -> DataFrame:
    """Runs per status, total, newest run and success rate (stopped and active runs
    are not part of the rate)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return jobs.groupBy("user_id").agg(
        F.count("*").alias("total_runs"), *counts, F.max("created_at").alias("last_run_at")
    ).withColumn("success_rate", success_rate(F.col("success"), F.col("failed")))


def run_medians(champions: DataFrame) -> DataFrame:
    """Median finite champion WMAPE per job. A job may hold very many series, so the
    exact rank is found without gathering a job in one task."""
    scored = champions.select("job_id", rules.finite(F.col("wmape")).alias("wmape"))
    return exact_percentiles(scored, ["job_id"], "wmape", {"wmape": 0.5})


def recent_runs(jobs: DataFrame, model_runs: DataFrame) -> DataFrame:
    newest = _newest(jobs, RECENT_RUNS)
    champs = join_facts(_champions(model_runs), newest.select(F.col("id").alias("job_id")), ["job_id"], ["id"])
    order = F.struct(F.coalesce("sheet_name", F.lit("")), F.coalesce("metric_name", F.lit("")), "id")
    per_job = champs.groupBy("job_id").agg(
        F.min_by("model_name", order).alias("champion_model"), F.count("*").alias("metric_count")
    )
    return (
        newest.withColumnRenamed("id", "job_id")
        .join(per_job, "job_id", "left").join(run_medians(champs), "job_id", "left")
        .select("user_id", "place", "job_id", "name", "file_name", "status", "created_at", "champion_model",
                F.coalesce("metric_count", F.lit(0)).alias("metric_count"), "wmape")
    )


def accuracy_trend(jobs: DataFrame, model_runs: DataFrame) -> DataFrame:
    """Per owner: the newest 20 successful scored runs, one median each, oldest first."""
    done = jobs.where("status = 'success'")
    scored_rows = _champions(model_runs).where("wmape is not null")
    scored = done.join(scored_rows.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
    window = _newest(scored, TREND_RUNS).select("user_id", F.col("id").alias("job_id"), "created_at")
    rows = join_facts(scored_rows, window.select("job_id"), ["job_id"], ["id"])
    points = window.join(run_medians(rows), "job_id")
    w = Window.partitionBy("user_id").orderBy("created_at", "job_id")
    return points.withColumn("position", F.row_number().over(w))


def trend_headline(trend: DataFrame) -> DataFrame:
    """Median of at most 20 run medians per owner."""
    return trend.groupBy("user_id").agg(F.percentile("wmape", F.lit(0.5)).alias("median_wmape"))


def demand_mix(jobs: DataFrame, model_runs: DataFrame) -> DataFrame:
    """Distinct series per demand class; the latest run of a series decides."""
    facts = jobs.select(F.col("id").alias("job_id"), "user_id", "created_at",
                        F.coalesce("file_name", F.col("id").cast("string")).alias("source"))
    rows = join_facts(_champions(model_runs), facts, ["job_id"], ["id"])
    latest = rows.groupBy("user_id", "source", "sheet_name", "metric_name").agg(
        F.max_by(F.struct("demand_type"), F.struct("created_at", "job_id", "id")).alias("_d")
    )
    kind = F.when(F.col("_d.demand_type").isin(*DEMAND_TYPES), F.col("_d.demand_type")).otherwise("unclassified")
    return latest.select("user_id", kind.alias("demand_type")).groupBy("user_id", "demand_type").agg(
        F.count("*").alias("series")
    )


def active_runs(jobs: DataFrame) -> DataFrame:
    return _newest(jobs.where(F.col("status").isin(*ACTIVE)), ACTIVE_RUNS).select(
        "user_id", "place", F.col("id").alias("job_id"), "status", "created_at", "started_at"
    )


def timed_runs(jobs: DataFrame) -> DataFrame:
    """The newest 20 successful runs with a usable duration. A completion before the
    start is a clock problem, not a run."""
    usable = jobs.where("status = 'success' and started_at is not null and completed_at is not null "
                        "and completed_at >= started_at")
    # parts of the interval: right for zoned and for wall-clock timestamps alike
    took = F.col("completed_at") - F.col("started_at")
    seconds = sum((F.date_part(F.lit(unit), took).cast("double") * size
                   for unit, size in (("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))),
                  F.date_part(F.lit("DAY"), took).cast("double") * 86_400)
    return _newest(usable, TIMED_RUNS).withColumn("duration_seconds", seconds)


def run_time(jobs: DataFrame) -> DataFrame:
    return timed_runs(jobs).groupBy("user_id").agg(
        F.percentile("duration_seconds", F.lit(0.5)).alias("median_run_seconds")
    )


def slowest_runs(jobs: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("duration_seconds"), "id")
    return timed_runs(jobs).drop("place").withColumn("place", F.row_number().over(w)).where(
        F.col("place") <= SLOWEST_RUNS
    ).select("user_id", "place", F.col("id").alias("job_id"), "duration_seconds")


def model_wins(jobs: DataFrame, model_runs: DataFrame) -> DataFrame:
    """Series won per model, most wins first, then by name."""
    rows = join_facts(
        _champions(model_runs).where("model_name is not null"),
        jobs.select(F.col("id").alias("job_id"), "user_id"), ["job_id"], ["id"],
    )
    wins = rows.groupBy("user_id", "model_name").agg(F.count("*").alias("wins"))
    w = Window.partitionBy("user_id").orderBy(F.desc("wins"), "model_name")
    return wins.withColumn("place", F.row_number().over(w))


def fold_wins(wins: DataFrame, max_bars: int = WIN_BARS) -> DataFrame:
    """Keep the leaders and fold the rest into one bar, unless everything fits."""
    models = F.count("*").over(Window.partitionBy("user_id"))
    sized = wins.withColumn("_models", models)
    folded = (F.col("_models") > max_bars) & (F.col("place") >= max_bars)
    label = F.when(folded, F.concat(F.lit("Other ("), (F.col("_models") - max_bars + 1).cast("string"), F.lit(")"))).otherwise(F.col("model_name"))
    return sized.select("user_id", label.alias("label"), "wins", folded.alias("is_other"),
                        F.least("place", F.lit(max_bars)).alias("place")
                        ).groupBy("user_id", "label", "is_other").agg(
        F.sum("wins").alias("wins"), F.min("place").alias("place"))


def realized_headline(evaluations: DataFrame) -> DataFrame:
    """Median over runs of each run's median realized WMAPE. The newest evaluation of
    a series counts even when it matched nothing, and then hides older ones."""
    newest = evaluations.groupBy("user_id", "job_id", "sheet_name", "metric_name").agg(
        F.max_by(F.struct("matched_points", "wmape"), F.struct("created_at", "id")).alias("e")
    ).where("e.matched_points > 0").select("user_id", "job_id", rules.finite(F.col("e.wmape")).alias("wmape"))
    per_run = exact_percentiles(newest, ["user_id", "job_id"], "wmape", {"wmape": 0.5})
    medians = exact_percentiles(per_run, ["user_id"], "wmape", {"realized_wmape": 0.5})
    runs = per_run.groupBy("user_id").agg(F.count("wmape").alias("realized_runs"))
    return medians.join(runs, "user_id")


def history_page(jobs: DataFrame, model_runs: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of each owner's runs, newest first, with a row per champion. The rows
    stay flat: a run may hold very many series."""
    totals = jobs.groupBy("user_id").agg(F.count("*").alias("total"))
    page = _newest(jobs, offset + limit).where(F.col("place") > offset).withColumnRenamed("id", "job_id")
    champs = _champions(model_runs).select("job_id", "sheet_name", "metric_name", "model_name", "wmape", "id")
    kept = join_facts(champs, page.select("job_id"), ["job_id"], ["id"]).drop("id")
    return page.join(totals, "user_id").join(kept, "job_id", "left").select(
        "user_id", "total", "place", "job_id", "status", "created_at", "sheet_name", "metric_name", "model_name", "wmape"
    )
