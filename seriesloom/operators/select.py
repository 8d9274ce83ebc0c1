"""Champion selection, leaderboard rows and record assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.functions import rules

# Scores are compared at nine decimals: the order of a distributed sum moves the last
# bits, and a tie must not depend on it.
TIE_DIGITS = 9
SCORES = ("wmape", "mae", "mape", "rmse", "accuracy", "composite_score")
RUN_KEY = ("job_id", "sheet_name", "metric_name")
BASELINE = "Baseline_SMA"


def overlap_gate(pairs: DataFrame) -> DataFrame:
    """Per (series, model): is the test window rich enough to score the model?"""
    usable = F.col("actual").isNotNull() & (F.col("actual") != 0) & F.col("predicted").isNotNull()
    needed = rules.min_test_overlap(F.col("n_test"))
    return pairs.groupBy("series_id", "model").agg(
        F.count("*").alias("n_test"), F.count_if(usable).alias("n_overlap")
    ).select(
        "series_id", "model", "n_test", "n_overlap", needed.alias("needed"),
        F.when(F.col("n_overlap") >= needed, "completed").otherwise("skipped").alias("status"),
        F.when(F.col("n_overlap") < needed, F.format_string(
            "Insufficient test overlap: %d pts, need %d", "n_overlap", needed
        )).alias("reason"),
    )


def select_champion(scores: DataFrame) -> DataFrame:
    """Lowest composite score per series among completed models; ties go to the
    earlier routing rank. One aggregate, no window."""
    fields = [c for c in scores.columns if c != "series_id"]
    best = F.min_by(F.struct(*fields), F.struct(F.round("composite_score", TIE_DIGITS), "rank"))
    return scores.where("status = 'completed' and composite_score is not null").groupBy("series_id").agg(
        best.alias("b")
    ).select("series_id", "b.*")


def mask_truth(pairs: DataFrame) -> DataFrame:
    """Rows a multivariate candidate is scored on: actual known and not negative."""
    return pairs.where(F.col("actual").isNotNull() & (F.col("actual") >= 0))


def challenger_wins(uni_wmape: Column, mv_wmape: Column, uni_std: Column, mv_std: Column) -> Column:
    """A challenger must not be flat, and must win clearly, or win while keeping
    at least 30 % of the incumbent forecast's spread."""
    u, m = F.coalesce(uni_wmape, F.lit(1.0)), F.coalesce(mv_wmape, F.lit(1.0))
    spread = F.coalesce(mv_std, F.lit(0.0))
    return (spread > 1e-6) & (
        (m < u * 0.95) | ((m < u) & (spread >= 0.3 * F.coalesce(uni_std, F.lit(0.0))))
    )


def judge_challengers(both: DataFrame) -> DataFrame:
    """(series_id, uni_wmape, mv_wmape, uni_std, mv_std) plus ``accepted``."""
    return both.withColumn("accepted", challenger_wins(
        F.col("uni_wmape"), F.col("mv_wmape"), F.col("uni_std"), F.col("mv_std")
    ))


def forecast_floor(train: DataFrame) -> DataFrame:
    """Lowest value a forecast may take for a series that is rarely zero; null for
    sparse series. Reads the last 90 training days."""
    recent = train.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("ds")))
    )
    sold = F.when((F.col("_rank") <= 90) & (F.col("y") > 0), F.col("y"))
    facts = recent.groupBy("series_id").agg(
        (F.count_if(F.col("y") == 0) / F.count("*")).alias("zero_ratio"),
        F.percentile(sold, F.lit(0.10)).alias("_q10"), F.min(sold).alias("_low"),
    )
    return facts.select("series_id", "zero_ratio", F.when(
        F.col("zero_ratio") <= 0.10, F.greatest("_q10", "_low") * 0.9
    ).alias("floor"))


def apply_floor(forecasts: DataFrame, floors: DataFrame) -> DataFrame:
    lifted = F.greatest(F.col("yhat"), F.coalesce(F.col("floor"), F.lit(0.0)), F.lit(0.0))
    return forecasts.join(floors.select("series_id", "floor"), "series_id", "left").withColumn(
        "yhat", lifted
    ).drop("floor")


def revert_to_baseline(champions: DataFrame, baseline_scores: DataFrame) -> DataFrame:
    """Replace a champion the moving average beats. A score of 0.0 is a real score."""
    base = baseline_scores.select("series_id", *[F.col(s).alias(f"_b_{s}") for s in SCORES if s in baseline_scores.columns])
    joined = champions.join(base, "series_id", "left")
    reverted = F.col("_b_wmape").isNotNull() & (
        F.col("wmape").isNull() | (F.round("_b_wmape", TIE_DIGITS) < F.round("wmape", TIE_DIGITS))
    )
    out = joined.withColumn("reverted", reverted)
    for s in SCORES:
        if f"_b_{s}" in out.columns and s in champions.columns and s != "wmape":
            out = out.withColumn(s, F.when(F.col("reverted"), F.col(f"_b_{s}")).otherwise(F.col(s)))
    if "composite_score" in champions.columns and "_b_composite_score" not in out.columns:
        out = out.withColumn("composite_score", F.when(~F.col("reverted"), F.col("composite_score")))
    return out.withColumn("model", F.when(F.col("reverted"), BASELINE).otherwise(F.col("model"))).withColumn(
        "wmape", F.when(F.col("reverted"), F.col("_b_wmape")).otherwise(F.col("wmape"))
    ).drop(*[c for c in out.columns if c.startswith("_b_")])


def leaderboard(completed: DataFrame, skipped: DataFrame, failed: DataFrame, profile: DataFrame) -> DataFrame:
    """One row per model tried. Skipped and failed rows carry a reason and no scores."""
    def shaped(df: DataFrame, status: str) -> DataFrame:
        have = df.columns
        return df.select(
            "series_id", F.col("model").alias("model_name"),
            (F.coalesce(F.col("stage"), F.lit("Univariate")) if "stage" in have else F.lit("Univariate")).alias("stage"),
            *[(rules.finite(F.col(s)) if s in have and status == "completed" else F.lit(None).cast("double")).alias(s) for s in SCORES],
            F.lit(status).alias("status"),
            (F.col("reason") if "reason" in have else F.lit(None).cast("string")).alias("error_message"),
        )
    rows = shaped(completed, "completed").unionByName(shaped(skipped, "skipped")).unionByName(shaped(failed, "failed"))
    return rows.join(profile.select("series_id", "demand_type", "adi", "cv2"), "series_id", "left")


def flag_champions(board: DataFrame, headline: DataFrame) -> DataFrame:
    """Add ``is_champion``: the first entry (by ``position``) named by the headline's
    best_model; at most one per key."""
    named = board.join(headline.select(*RUN_KEY, "best_model"), list(RUN_KEY), "left")
    match = F.coalesce(F.col("model_name") == F.col("best_model"), F.lit(False))
    first = F.min(F.when(match, F.col("position"))).over(Window.partitionBy(*RUN_KEY))
    return named.withColumn("_first", first).withColumn(
        "is_champion", match & (F.col("position") == F.col("_first"))
    ).drop("best_model", "_first")


def _from_headline(headline: DataFrame, columns: list[str]) -> DataFrame:
    stage = F.when(F.col("is_multivariate"), "Multivariate").otherwise("Univariate")
    made = headline.withColumn("model_name", F.col("best_model")).withColumn("stage", stage).withColumn(
        "status", F.lit("completed")
    ).withColumn("error_message", F.lit(None).cast("string")).withColumn(
        "is_champion", F.col("best_model").isNotNull()
    )
    return made.select(*columns)


def model_runs(board: DataFrame, headline: DataFrame) -> DataFrame:
    """Rows of the run history. A key whose board is empty, or lacks its winner, gets
    a champion row made from the headline."""
    columns = [*RUN_KEY, "model_name", "stage", *SCORES, "status", "error_message", "is_champion"]
    flagged = flag_champions(board, headline)
    entries = flagged.select(*RUN_KEY, "model_name", F.coalesce("stage", F.lit("Univariate")).alias("stage"),
                             *[rules.finite(F.col(s)).alias(s) for s in SCORES],
                             F.coalesce("status", F.lit("completed")).alias("status"), "error_message", "is_champion")
    clean_headline = headline.select(*RUN_KEY, "best_model", "is_multivariate",
                                     *[rules.finite(F.col(s)).alias(s) for s in SCORES])
    seen = flagged.groupBy(*RUN_KEY).agg(F.bool_or("is_champion").alias("_won"))
    state = clean_headline.join(seen, list(RUN_KEY), "left")
    missing = state.where(F.col("_won").isNull() | (~F.col("_won") & F.col("best_model").isNotNull()))
    return entries.unionByName(_from_headline(missing, columns))


def sort_leaderboard(rows: DataFrame, by: str, ascending: bool = True, tiebreak: Sequence[str] = ("model_name",)) -> DataFrame:
    """Add ``place`` per key: champion first, then the chosen score, missing scores
    last, then the name and whatever else breaks ties."""
    score = F.when(~F.isnan(F.col(by)), F.col(by))
    order = score.asc_nulls_last() if ascending else score.desc_nulls_last()
    w = Window.partitionBy(*RUN_KEY).orderBy(F.col("is_champion").desc(), order, *tiebreak)
    return rows.withColumn("place", F.row_number().over(w))


def assemble_records(parts: DataFrame) -> DataFrame:
    """(series_id, ds, kind, value) to one row per (series, date).

    ``kind`` is train_actual, train_raw, test_actual, test_prediction or forecast.
    A null prediction or forecast becomes 0; a null actual stays null. One grouped
    aggregate replaces a chain of full outer joins.
    """
    kinds = ("train_actual", "train_raw", "test_actual", "test_prediction", "forecast")
    value = F.when(F.col("kind").isin("test_prediction", "forecast"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return parts.withColumn("value", value).groupBy("series_id", "ds").agg(*[
        F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in kinds
    ])


def attach_covariates(records: DataFrame, covariates: DataFrame) -> DataFrame:
    """Add ``x``: MAP of covariate name to value on the record's date."""
    per_day = covariates.groupBy("series_id", "ds").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("x_name", "x")))).alias("x")
    )
    return records.join(per_day, ["series_id", "ds"], "left")


def boundary_date(records: DataFrame) -> DataFrame:
    """Per series: the last record before the first one without any actual."""
    bare = F.col("train_actual").isNull() & F.col("test_actual").isNull()
    first_bare = F.min(F.when(bare, F.col("ds"))).over(Window.partitionBy("series_id"))
    return records.withColumn("_bare", first_bare).groupBy("series_id").agg(
        F.max(F.when(F.col("ds") < F.col("_bare"), F.col("ds"))).alias("boundary_date")
    )


def status_rows(attempted: DataFrame, scored: DataFrame, errors: DataFrame) -> DataFrame:
    """What became of every attempted (series, model): a failure never removes others."""
    key = ["series_id", "model"]
    return attempted.select(*key).join(scored.select(*key, F.lit(True).alias("_ok")), key, "left").join(
        errors.select(*key, "error"), key, "left"
    ).select(
        *key,
        F.when(F.col("error").isNotNull(), "failed").when(F.col("_ok"), "completed").otherwise("skipped").alias("status"),
        "error",
    )
