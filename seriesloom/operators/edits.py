"""Forecast edits: validated operations, replayed on an immutable baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ("job_id", "sheet_name", "metric_name")
# The operation types an edit may have.
OPERATIONS = ("set_value_range", "scale_range", "clip_bounds")
_JSON_FIELDS = (
    "operation_type STRING, value STRING, scale_pct STRING, min_value STRING, max_value STRING, "
    "date_from STRING, date_to STRING, days_of_week STRING"
)


def matches(op: Column, day: Column) -> Column:
    """Does the edit's date range and weekday list (Monday = 0) cover this day?"""
    return (
        (op["date_from"].isNull() | (day >= op["date_from"]))
        & (op["date_to"].isNull() | (day <= op["date_to"]))
        & (op["days_of_week"].isNull() | F.array_contains(op["days_of_week"], F.weekday(day)))
    )


def apply_operation(op: Column, day: Column, forecast: Column) -> Column:
    """The forecast after one edit. A null forecast is never touched."""
    bounded = F.least(F.greatest(forecast, op["min_value"]), op["max_value"])
    edited = (
        F.when(op["operation_type"] == "set_value_range", op["value"])
        .when(op["operation_type"] == "scale_range", forecast * (op["scale_pct"] / 100.0))
        .when(op["operation_type"] == "clip_bounds", bounded)
        .otherwise(forecast)
    )
    return F.when(forecast.isNotNull() & matches(op, day), edited).otherwise(forecast)


def edit_stacks(edits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per key with its edits as an array in sequence order. A stack is what
    people typed, so it is short."""
    op = F.struct(
        "sequence_no", "operation_type", "value", "scale_pct", "min_value", "max_value",
        "date_from", "date_to", "days_of_week",
    )
    return edits.groupBy(*key).agg(F.array_sort(F.collect_list(op)).alias("edits"))


def replay(records: DataFrame, edits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Add ``edited_forecast``: the baseline with every edit applied in order."""
    stacked = records.join(edit_stacks(edits, key), list(key), "left")
    folded = F.aggregate(
        F.col("edits"), F.col("forecast"), lambda acc, op: apply_operation(op, F.col("ds"), acc)
    )
    return stacked.withColumn(
        "edited_forecast", F.when(F.col("edits").isNull(), F.col("forecast")).otherwise(folded)
    ).drop("edits")


def replay_steps(records: DataFrame, edits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row per (record, edit): the forecast right after that edit."""
    stacked = records.join(edit_stacks(edits, key), list(key))
    step = F.posexplode("edits").alias("_i", "op")
    upto = F.aggregate(
        F.slice("edits", F.lit(1), F.col("_i") + 1), F.col("forecast"),
        lambda acc, op: apply_operation(op, F.col("ds"), acc),
    )
    return stacked.select("*", step).select(
        *key, "ds", F.col("op.sequence_no").alias("sequence_no"),
        F.col("op.operation_type").alias("operation_type"), upto.alias("forecast_after"),
        F.when(F.col("_i") == 0, F.col("forecast")).otherwise(F.aggregate(
            F.slice("edits", F.lit(1), F.greatest(F.col("_i"), F.lit(1))), F.col("forecast"),
            lambda acc, op: apply_operation(op, F.col("ds"), acc),
        )).alias("forecast_before"),
        (F.col("forecast").isNotNull() & matches(F.col("op"), F.col("ds"))).alias("touched"),
    )


def affected_before(records: DataFrame, edits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """(key, sequence_no, ds, forecast): exactly the rows each edit touches, with the
    value they had just before it."""
    return replay_steps(records, edits, key).where("touched").select(
        *key, "sequence_no", "ds", F.col("forecast_before").alias("forecast")
    )


def revert_latest(edits: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """The stacks without each key's newest edit."""
    newest = F.max("sequence_no").over(Window.partitionBy(*key))
    return edits.withColumn("_newest", newest).where(F.col("sequence_no") < F.col("_newest")).drop("_newest")


# Reasons whose wording must match.
BAD_WEEKDAYS = "days_of_week values must be 0-6"
BAD_BOUNDS = "max_value must be >= min_value"


def validate(requests: DataFrame, text: str = "raw_text") -> DataFrame:
    """Parse edit requests: adds ``op`` (typed struct) or ``rejected`` (the reason).

    The text may be JSON, or hold one JSON object between other words. Nothing in
    it is ever executed.
    """
    raw = F.col(text)
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    body = F.when(F.try_parse_json(raw).isNotNull(), raw).when(F.try_parse_json(inner).isNotNull(), inner)
    parsed = requests.withColumn("_json", body).withColumn("_f", F.from_json("_json", _JSON_FIELDS))
    f = F.col("_f")
    number = {n: f[n].try_cast("double") for n in ("value", "scale_pct", "min_value", "max_value")}
    day = {n: f[n].try_cast("date") for n in ("date_from", "date_to")}
    dows = F.from_json(f["days_of_week"], "ARRAY<INT>")
    kind = f["operation_type"]
    unread = F.lit(False)
    for name, col in {**number, **day}.items():
        unread = unread | (f[name].isNotNull() & col.isNull())
    bad_dow = f["days_of_week"].isNotNull() & (
        dows.isNull() | F.exists(dows, lambda d: d.isNull() | ~d.between(0, 6))
    )
    reason = (
        F.when(F.col("_json").isNull(), "not valid JSON")
        .when(kind == "none", "not a forecast edit")
        .when(kind.isNull() | ~kind.isin(*OPERATIONS), "unknown operation type")
        .when(unread, "unreadable parameter")
        .when(bad_dow, BAD_WEEKDAYS)
        .when((kind == "set_value_range") & number["value"].isNull(), "value is required")
        .when((kind == "scale_range") & number["scale_pct"].isNull(), "scale_pct is required")
        .when((kind == "clip_bounds") & (number["max_value"] < number["min_value"]), BAD_BOUNDS)
    )
    op = F.struct(
        kind.alias("operation_type"), *[c.alias(n) for n, c in number.items()],
        *[c.alias(n) for n, c in day.items()], dows.alias("days_of_week"),
    )
    return parsed.withColumn("rejected", reason).withColumn(
        "op", F.when(F.col("rejected").isNull(), op)
    ).drop("_json", "_f")


def metric_context(records: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Count, mean, min and max of the history and of the current forecast."""
    def four(col: str, name: str) -> list[Column]:
        return [F.count(col).alias(f"{name}_points"), F.avg(col).alias(f"{name}_mean"),
                F.min(col).alias(f"{name}_min"), F.max(col).alias(f"{name}_max")]
    has = F.when(F.col("forecast").isNotNull(), F.col("ds"))
    return records.groupBy(*key).agg(
        *four("train_actual", "history"), *four("forecast", "forecast"),
        F.min(has).alias("forecast_from"), F.max(has).alias("forecast_to"),
    )
