"""Models trained once over all series, and their recursive forecasts.

Every series is scaled by its own training mean, so one model serves them all. Boosters minimise the pinball loss,
so a share of the targets lies below their forecasts. Trees and ridge come from sums that Spark adds up; a fitted
model is a few arrays, whose size is checked, and the whole horizon of many series is rolled in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from seriesloom.operators import metrics as M, trees as T
from seriesloom.operators.features import LAGS, MAX_AUTO_LAG, calendar, cyclical, univariate_features
from seriesloom.functions.timecols import is_month_end, is_month_start, is_weekend
from seriesloom.session import materialize

# Input columns of every pooled model.
HISTORY_FEATURES = [f"lag_{k}" for k in LAGS] + ["roll_mean_7", "roll_mean_14", "roll_mean_28", "roll_max_7", "roll_std_7"]
CALENDAR_FEATURES = ["dow", "month", "dom", "doy", "is_month_end", "is_month_start", "is_weekend",
                     "month_sin", "month_cos", "dow_sin", "dow_cos"]
FEATURES = HISTORY_FEATURES + CALENDAR_FEATURES
STATE_DAYS = 28
QUANTILE = 0.75
ROLL_ROWS = 500  # series that are rolled together

# Rounds, shrinkage, most leaves and depth, and least rows of a leaf of each booster.
BOOSTERS = {
    "LightGBM": {"trees": 300, "shrink": 0.05, "leaves": 31, "depth": 6, "least": 10},
    "HistGB": {"trees": 300, "shrink": 0.05, "leaves": 31, "depth": 8, "least": 20},
    "XGBoost": {"trees": 300, "shrink": 0.05, "leaves": 64, "depth": 6, "least": 1},
}
EXTRA_TREES = {"trees": 200, "depth": 15}
# Read their rows once or twice (Huber keeps blocks of its own), so the rows are worked out again instead of written.
FEW_PASSES = ("Ridge", "Huber")


def scales(train: DataFrame) -> DataFrame:
    return train.groupBy("series_id").agg(F.greatest(F.avg(F.abs("y")), F.lit(1e-6)).alias("scale"))


def training_frame(train: DataFrame, scale: DataFrame) -> DataFrame:
    """Scaled features and target of every training day; where the history is short, features are filled."""
    scaled = train.join(scale.hint("shuffle_hash"), "series_id").select("series_id", "ds", (F.col("y") / F.col("scale")).alias("y"))
    return univariate_features(scaled).select("series_id", "ds", "y", *FEATURES)


@dataclass
class Fitted:
    """A fitted model: trees, or a line's weights."""

    name: str
    features: list[str]
    trees: T.Trees | None = None
    weights: np.ndarray | None = None
    intercept: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.trees.predict(x) if self.trees is not None else x @ self.weights + self.intercept

    def importance(self) -> np.ndarray:
        """Shares of the trees' gain, or absolute weights."""
        if self.trees is None:
            return np.abs(self.weights)
        total = self.trees.importance.sum()
        return self.trees.importance / total if total else self.trees.importance


def is_booster(name: str) -> bool:
    return name in BOOSTERS


def fit_model(name: str, frame: DataFrame, features: Sequence[str], q: float = QUANTILE, target: str = "y", **settings: float) -> Fitted:
    """Fit a model by its leaderboard name on rows of ``features`` and ``target``. Settings override the fixed values."""
    features = list(features)
    if is_booster(name):
        return Fitted(name, features, trees=T.boost(frame, features, q, target=target, **{**BOOSTERS[name], **settings}))
    if name == "ExtraTrees":
        return Fitted(name, features, trees=T.extra_trees(frame, features, target=target, **{**EXTRA_TREES, **settings}))
    if name == "Ridge":
        weights, intercept = ridge(frame, features, target, **settings)
        return Fitted(name, features, weights=weights, intercept=intercept)
    if name == "Huber":
        line = LinearRegression(labelCol=target, loss="huber", epsilon=1.35, regParam=0.0001, **{**{"maxIter": 2000}, **settings})
        rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(frame.select(target, *features))
        model = line.fit(rows)
        return Fitted(name, features, weights=np.array(model.coefficients), intercept=float(model.intercept))
    raise ValueError(f"unknown pooled model: {name}")


def ridge(frame: DataFrame, features: Sequence[str], target: str = "y", alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the squared error plus ``alpha`` times the squared weights of the standardised
    features. One pass adds up the products of all pairs of columns; the normal equations of that small matrix are
    solved here. A constant feature has weight 0."""
    size = len(features) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([np.ones(batch.num_rows), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)])
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["cell", "v"])
    rows = frame.select(*[F.col(f).cast("double") for f in features], F.col(target).cast("double").alias("_target"))
    cells = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros(size * size)
    for r in cells:
        gram[r["cell"]] = r["v"]
    gram = gram.reshape(size, size)
    n = gram[0, 0]
    if not n:
        return np.zeros(size - 2), 0.0
    mean = gram[0, 1:] / n
    spread = gram[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(spread)[:-1], 0))
    varies = sd > 1e-9 * np.maximum(1.0, np.abs(mean[:-1]))
    sd = np.where(varies, sd, 1.0)
    a = n * spread[:-1, :-1] / np.outer(sd, sd) + alpha * np.eye(size - 2)
    b = np.where(varies, n * spread[:-1, -1] / sd, 0.0)
    a[~varies], a[:, ~varies] = 0.0, 0.0
    a[~varies, ~varies] = 1.0
    weights = np.linalg.solve(a, b) / sd
    return weights, float(mean[-1] - mean[:-1] @ weights)


def start_states(fit_rows: DataFrame, scale: DataFrame, days: int = STATE_DAYS) -> DataFrame:
    """Per (series_id, kind): the last ``days`` scaled values, or all of a shorter series, and the last day. The rank has
    a fixed bound, so only those rows move."""
    w = Window.partitionBy("series_id", "kind").orderBy(F.desc("ds"))
    newest = fit_rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= days)
    return newest.join(scale, "series_id").groupBy("series_id", "kind", "scale").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ds", (F.col("y") / F.col("scale")).alias("v")))), lambda s: s["v"]).alias("state"),
        F.max("ds").alias("last_ds"),
    )


def future_row(state: Column, day: Column) -> list[Column]:
    """Model inputs for ``day`` from the last 28 values before it."""
    def back(k: int) -> Column:
        return F.coalesce(F.try_element_at(state, F.lit(-k)), F.lit(0.0))

    def last(k: int) -> Column:
        return F.slice(state, F.greatest(F.lit(1), F.size(state) - k + 1), F.lit(k))

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    week = last(7)
    centre = mean(week)
    spread = F.aggregate(week, F.lit(0.0), lambda a, v: a + (v - centre) * (v - centre))
    made = {f"lag_{k}": back(k) for k in LAGS}
    made |= {f"roll_mean_{k}": mean(last(k)) for k in (7, 14, 28)}
    made |= {
        "roll_max_7": F.array_max(week),
        "roll_std_7": F.when(F.size(week) > 1, F.sqrt(spread / (F.size(week) - 1))).otherwise(0.0),
        "dow": F.weekday(day), "month": F.month(day), "dom": F.dayofmonth(day), "doy": F.dayofyear(day),
        "is_month_end": is_month_end(day), "is_month_start": is_month_start(day), "is_weekend": is_weekend(day),
    }
    for name, size in (("month", 12), ("dow", 7)):
        angle = F.lit(2 * math.pi) * made[name] / size
        made |= {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}
    return [made[name].cast("double").alias(name) for name in FEATURES]


def history_columns(state: np.ndarray, monday: np.ndarray, own: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Features of the next day from the values before it: ``state`` is (series, days), the newest value last and nan
    where there is none. With ``own`` (series, lags from 1), only these lags count, and the columns are the challengers'."""
    def filled(v: np.ndarray, start: float = 0.0) -> np.ndarray:
        return np.where(np.isfinite(v), v, start)

    def stat(fn, k: int, least: int = 1) -> np.ndarray:
        last = state[:, -k:]
        known = np.isfinite(last)
        enough = known.sum(axis=1) >= least
        return np.where(enough, fn(last, known), np.nan)

    def mean(v, known):
        return np.where(known, v, 0).sum(axis=1) / np.maximum(known.sum(axis=1), 1)

    def std(v, known):
        apart = np.where(known, v - mean(v, known)[:, None], 0)
        return np.sqrt((apart * apart).sum(axis=1) / np.maximum(known.sum(axis=1) - 1, 1))

    def most(v, known):
        return np.where(known, v, -np.inf).max(axis=1)
    made = {f"lag_{k}": filled(state[:, -k]) if k <= state.shape[1] else np.zeros(len(state)) for k in range(1, MAX_AUTO_LAG + 1)}
    made |= {f"roll_mean_{k}": filled(stat(mean, k)) for k in (7, 14, 28)}
    made |= {f"roll_max_{k}": filled(stat(most, k)) for k in (3, 7, 14, 28)}
    made["roll_std_7"] = filled(stat(std, 7, 2))
    if own is not None:
        trend = np.where(own[:, 6], made["lag_7"], made["lag_1"])
        made["smart_momentum"] = np.where(monday, made["lag_3"], made["lag_1"])
        made["trend_strength"] = trend / (made["roll_mean_7"] + 1e-6)
        made["volatility_ratio"] = made["roll_std_7"] / (filled(stat(std, 28, 2), 1e-6) + 1e-6)
        made["spike_ratio"] = made["lag_1"] / (made["roll_max_28"] + 1e-6)
        made |= {f"lag_{k}": np.where(own[:, k - 1], made[f"lag_{k}"], 0.0) for k in range(1, MAX_AUTO_LAG + 1)}
    return made


def roll(fitted: Fitted, state: np.ndarray, known: dict[str, np.ndarray], own: np.ndarray | None = None,
         to_value=None) -> np.ndarray:
    """(series, steps): predictions where each one becomes the next step's newest value, for many series at once.

    ``known`` holds (series, steps) arrays of the features that do not depend on past values. ``to_value`` turns the
    model's output into a scaled value. A prediction that is not finite is nan in the path; the last value stands in for it."""
    steps = known["dow"].shape[1]
    days = state.shape[1]
    line = np.concatenate([state, np.full((len(state), steps), np.nan)], axis=1)
    path = np.full((len(state), steps), np.nan)
    for t in range(steps):
        with np.errstate(over="ignore", invalid="ignore"):
            made = history_columns(line[:, t:t + days], known["dow"][:, t] == 0, own)
            x = np.column_stack([known[f][:, t] if f in known else made[f] for f in fitted.features])
            value = fitted.predict(np.where(np.isfinite(x), x, 0.0))
            value = value if to_value is None else to_value(value)
        path[:, t] = np.where(np.isfinite(value), np.maximum(value, 0.0), np.nan)
        line[:, days + t] = np.where(np.isfinite(path[:, t]), path[:, t], line[:, days + t - 1])
    return path


PATH = pa.schema([("series_id", pa.string()), ("kind", pa.string()), ("path", pa.list_(pa.float64()))])


def known_days(wanted: DataFrame, names: Sequence[str]) -> DataFrame:
    """(series_id, kind, days): per target, in order, an array of the ``names`` columns of ``wanted``."""
    row = F.struct("step", F.array(*[F.col(n).cast("double") for n in names]).alias("v"))
    return wanted.groupBy("series_id", "kind").agg(F.transform(F.array_sort(F.collect_list(row)), lambda s: s["v"]).alias("days"))


def rolled_paths(fitted: Fitted, states: DataFrame, days: DataFrame, names: Sequence[str], on_log: bool = False, width: int = STATE_DAYS) -> DataFrame:
    """(series_id, kind, path): the whole horizon of every series in one pass, in the series' own units.

    ``states`` has (series_id, kind, scale, state) and, for challengers, ``lags``, ``use_log`` and ``target_scale``. A series
    is one row, so a batch holds a bounded number of days; ``ROLL_ROWS`` series are rolled together."""
    wide = "lags" in states.columns
    extra = ["lags", "use_log", "target_scale"] if wide else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, ROLL_ROWS) for at in range(0, batch.num_rows, ROLL_ROWS)):
                ids, kinds, scale, state, ahead = (part.column(c).to_pylist() for c in ("series_id", "kind", "scale", "state", "days"))
                rows, steps = len(ids), max(map(len, ahead), default=0)
                past = np.full((rows, width), np.nan)
                known = np.zeros((rows, steps, len(names)))
                for k, (s, a) in enumerate(zip(state, ahead)):
                    s = np.array(s[-width:], dtype=float)
                    past[k, width - len(s):] = s
                    known[k, :len(a)] = np.array(a, dtype=float).reshape(len(a), len(names))
                scale, own, to_value = np.array(scale), None, None
                if wide:
                    own = np.zeros((rows, MAX_AUTO_LAG), bool)
                    for k, lags in enumerate(part.column("lags").to_pylist()):
                        own[k, np.array(lags, dtype=int) - 1] = True
                    if on_log:
                        log, unit = (np.array(part.column(c).to_pylist()) for c in ("use_log", "target_scale"))
                        to_value = lambda v: np.where(log, np.expm1(np.minimum(v * unit, 700)), v * unit) / scale
                path = roll(fitted, past, {n: known[:, :, k] for k, n in enumerate(names)}, own, to_value) * scale[:, None]
                told = [[None if not math.isfinite(v) else v for v in path[k, :len(a)].tolist()] for k, a in enumerate(ahead)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, kinds, told), PATH)], schema=PATH)
    rows = states.select("series_id", "kind", "scale", "state", *extra).join(days, ["series_id", "kind"])
    return rows.mapInArrow(run, "series_id string, kind string, path array<double>")


def path_predictions(paths: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    return wanted.join(paths, ["series_id", "kind"]).select(
        "series_id", F.lit(name).alias("model"), "kind", "step", "ds", F.get("path", F.col("step") - 1).alias("yhat")).where("yhat is not null")


def fit_pooled(name: str, views: DataFrame, fit_rows: DataFrame, wanted: DataFrame, q: float = QUANTILE, **settings: float) -> tuple[DataFrame, Fitted]:
    """Train on all series' training windows and forecast test and future recursively.
    Returns predictions (series_id, model, kind, step, ds, yhat) and the model."""
    train = views.where("part = 'train'").select("series_id", "ds", "y")
    scale = scales(train)
    frame = training_frame(train, scale)
    fitted = fit_model(name, frame if name in FEW_PASSES else materialize(frame), FEATURES, q, **settings)
    days = known_days(cyclical(calendar(wanted)), CALENDAR_FEATURES)
    paths = rolled_paths(fitted, start_states(fit_rows, scale), days, CALENDAR_FEATURES)
    return path_predictions(paths, wanted, name), fitted


def feature_importance(fitted: Fitted, name: str, df: DataFrame) -> DataFrame:
    """Top ten positive importances: shares of the trees' gain, or absolute weights."""
    rows = [(name, f, float(v)) for f, v in zip(fitted.features, fitted.importance())]
    table = df.sparkSession.createDataFrame(rows, "model string, feature string, importance double")
    return table.where("importance > 0").orderBy(F.desc("importance"), "feature").limit(10).withColumn(
        "importance", F.round("importance", 4))


def binned_information(frame: DataFrame, features: Sequence[str], target: str = "y", bins: int = 16) -> DataFrame:
    """(feature, mi): mutual information of each feature with the target on quantile
    bins. Bin edges are bounded sketches; a task counts all features in one pass. A missing value lies in the first bin."""
    cuts = [i / bins for i in range(1, bins)]
    names = [target, *features]
    rows = frame.select(*[F.col(n).cast("double").alias(f"_{k}") for k, n in enumerate(names)])
    found = rows.agg(*[F.percentile_approx(c, cuts, 1000).alias(c) for c in rows.columns]).first()
    edges = [np.array(e or [], dtype=float) for e in found]  # a few dozen short rows whatever the data size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(features), bins * bins), np.int64)
        for batch in batches:
            of = [np.where(np.asarray(c.is_null()), 0, np.searchsorted(e, c.to_numpy(zero_copy_only=False))) for c, e in zip(batch.columns, edges)]
            for k in range(len(features)):
                n[k] += np.bincount(of[k + 1] * bins + of[0], minlength=bins * bins)
        at, cell = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([features[k] for k in at], pa.string()), pa.array(cell // bins), pa.array(cell % bins), pa.array(n[at, cell])],
                                         names=["feature", "_i", "_j", "_n"])
    cells = rows.mapInArrow(run, "feature string, _i long, _j long, _n long").groupBy("feature", "_i", "_j").agg(F.sum("_n").alias("_n"))
    all_, row, col = (Window.partitionBy("feature", *k) for k in ((), ("_i",), ("_j",)))
    n = F.sum("_n").over(all_)
    share = F.col("_n") / n
    independent = (F.sum("_n").over(row) / n) * (F.sum("_n").over(col) / n)
    return cells.select("feature", (share * F.log(share / independent)).alias("_t")).groupBy("feature").agg(F.sum("_t").alias("mi"))


def screen_features(frame: DataFrame, features: Sequence[str] = FEATURES, top: int = 15, cumulative: float = 0.95,
                    target: str = "y", **settings: float) -> DataFrame:
    """(feature, importance, mi, kept): kept when in the top by the importance of 100 random trees or by
    information, within the cumulative importance, or a calendar name."""
    fitted = fit_model("ExtraTrees", frame, features, target=target, **{**{"trees": 100, "depth": 30}, **settings})
    rows = [(f, float(v)) for f, v in zip(features, fitted.importance())]
    importance = frame.sparkSession.createDataFrame(rows, "feature string, importance double")
    both = importance.join(binned_information(frame, features, target), "feature")
    by_importance = Window.orderBy(F.desc("importance"), "feature")
    by_mi = Window.orderBy(F.desc("mi"), "feature")
    # Name parts that are always kept.
    forced = F.col("feature").rlike("sin|cos|month|quarter|week|holiday")
    return both.withColumn("_r", F.row_number().over(by_importance)).withColumn("_m", F.row_number().over(by_mi)).withColumn(
        "_c", F.sum("importance").over(by_importance)
    ).select("feature", "importance", "mi", ((F.col("_r") <= top) | (F.col("_m") <= top) | (F.col("_c") < cumulative) | forced).alias("kept"))


def blend_weights(scores: DataFrame, top: int = 2, max_gap: float = 0.20) -> DataFrame:
    """Inverse-WMAPE weights of each series' best models: (series_id, model, blend,
    best, weight). Series whose best model is far ahead, or perfect, get none."""
    w = Window.partitionBy("series_id").orderBy("wmape", "model")
    ranked = scores.where("wmape is not null").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top)
    names = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "model"))), lambda s: s["model"])
    eligible = ranked.groupBy("series_id").agg(
        F.count("*").alias("_n"), F.min("wmape").alias("best"), F.max("wmape").alias("_second"),
        F.sum(1 / (F.col("wmape") + F.lit(1e-8))).alias("_inv"),
        F.concat(F.lit("Ensemble["), F.array_join(names, "+"), F.lit("]")).alias("blend"),
    ).where((F.col("_n") == top) & (F.col("best") >= 1e-6) & ((F.col("_second") - F.col("best")) / (F.col("best") + 1e-8) <= max_gap))
    return ranked.join(eligible, "series_id").select(
        "series_id", "model", "blend", "best", ((1 / (F.col("wmape") + F.lit(1e-8))) / F.col("_inv")).alias("weight"))


def blend(pairs: DataFrame, scores: DataFrame, top: int = 2, max_gap: float = 0.20) -> DataFrame:
    """Weighted blend of each series' two best models, kept only when it beats the
    best. ``pairs`` (series_id, model, ds, actual, predicted), ``scores``
    (series_id, model, wmape). Returns (series_id, model, ds, actual, predicted)."""
    weighted = pairs.join(blend_weights(scores, top, max_gap), ["series_id", "model"])
    mixed = weighted.groupBy("series_id", F.col("blend").alias("model"), "best", "ds").agg(
        F.max("actual").alias("actual"), F.sum(F.col("predicted") * F.col("weight")).alias("predicted"))
    better = mixed.groupBy("series_id", "best").agg(M.wmape().alias("_blend")).where("_blend < best").select("series_id")
    return mixed.drop("best").join(better, "series_id", "left_semi")


def blend_forecasts(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Blended predictions of both kinds, with the weights found on the test window."""
    return predictions.join(weights, ["series_id", "model"]).groupBy("series_id", F.col("blend").alias("model"), "kind", "step", "ds").agg(
        F.sum(F.col("yhat") * F.col("weight")).alias("yhat"))
