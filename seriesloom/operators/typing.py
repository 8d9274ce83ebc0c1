"""From raw text tables to typed observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from seriesloom.functions.timecols import parse_when

_DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
# A number counts as a calendar year inside this range.
YEAR_FROM, YEAR_TO = 1900, 2100


def date_column_report(df: DataFrame, min_ratio: float = 0.8) -> DataFrame:
    """One row per column: how many values are set, how many read as dates, and
    whether the column is the date column. One pass over the data."""
    fields = df.schema.fields
    typed = [isinstance(f.dataType, _DATE_TYPES) for f in fields]
    aggregates = []
    for i, field in enumerate(fields):
        col = F.col(f"`{field.name}`")
        if typed[i]:
            reads = col.isNotNull()
        elif isinstance(field.dataType, T.NumericType):
            reads = col.between(YEAR_FROM, YEAR_TO)
        elif isinstance(field.dataType, T.StringType):
            reads = parse_when(F.trim(col)).isNotNull()
        else:
            reads = F.lit(False)
        aggregates += [F.count(col).alias(f"n{i}"), F.count_if(col.isNotNull() & reads).alias(f"d{i}")]
    totals = df.agg(*aggregates)
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(typed[i]).alias("is_typed"),
            F.col(f"n{i}").alias("n_values"), F.col(f"d{i}").alias("n_dates"),
        )
        for i, f in enumerate(fields)
    ])
    ratio = F.try_divide(F.col("n_dates").cast("double"), F.col("n_values").cast("double"))
    report = totals.select(F.explode(cells).alias("c")).select("c.*").withColumn("ratio", ratio)
    fits = F.col("is_typed") | F.coalesce(F.col("ratio") >= min_ratio, F.lit(False))
    # a typed column beats every text column; then the first in order wins
    choice = F.min(F.when(fits, F.struct((~F.col("is_typed")).alias("late"), "position"))).over(
        Window.partitionBy()
    )
    return report.withColumn(
        "is_date_column", F.coalesce(F.col("position") == choice["position"], F.lit(False))
    )


def infer_date_column(df: DataFrame, min_ratio: float = 0.8) -> str | None:
    """Name of the date column, or None. A typed column needs no data scan."""
    for field in df.schema.fields:
        if isinstance(field.dataType, _DATE_TYPES):
            return field.name
    found = date_column_report(df, min_ratio).where("is_date_column").select("column_name").take(1)
    return found[0][0] if found else None


def numeric_metrics(df: DataFrame, wanted: Sequence[str] | None = None) -> list[str]:
    """The wanted columns that exist, else all numeric ones; repeats removed, order kept."""
    if wanted:
        return [c for c in dict.fromkeys(wanted) if c in df.columns]
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def wide_to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per (ids, metric): every chosen metric column becomes its own series."""
    return df.select(*ids, *[F.col(f"`{m}`").cast("string").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "y_raw"
    )


def type_readings(df: DataFrame) -> DataFrame:
    """Add ``ds`` and ``y`` to (ds_raw, y_raw); unreadable cells become null."""
    return df.withColumn("ds", parse_when(F.trim("ds_raw"))).withColumn(
        "y", F.nanvl(F.trim("y_raw").try_cast("double"), F.lit(None).cast("double"))
    )


def drop_undated(df: DataFrame) -> DataFrame:
    return df.where(F.col("ds").isNotNull())


def typing_counts(df: DataFrame) -> DataFrame:
    """Per series: rows, rows without a usable date, and dated-or-not values that
    are present but not numeric."""
    return df.groupBy("series_id").agg(
        F.count("*").alias("rows_total"),
        F.count_if(F.col("ds").isNull()).alias("unparseable_dates"),
        F.count_if(F.col("ds").isNotNull() & F.col("y_raw").isNotNull() & F.col("y").isNull())
        .alias("non_numeric_values"),
    )


def selection_report(catalog: DataFrame, sheets: DataFrame, metrics: DataFrame) -> DataFrame:
    """What a selection asks for that the data does not hold.

    ``catalog`` (sheet, column_name), ``sheets`` (sheet), ``metrics`` (metric) are
    lists of names, not data. A missing sheet gives one row with a null metric; a
    sheet that exists gives one row per metric it lacks.
    """
    held = catalog.select("sheet").distinct()
    absent = sheets.distinct().join(held, "sheet", "left_anti").select(
        "sheet", F.lit(None).cast("string").alias("metric")
    )
    names = metrics.distinct().agg(F.collect_set("metric").alias("_all"))
    asked = (
        sheets.distinct().join(held, "sheet", "left_semi")
        .withColumn("_one", F.lit(1)).join(F.broadcast(names.withColumn("_one", F.lit(1))), "_one")
        .select("sheet", F.explode("_all").alias("metric"))
    )
    lacking = asked.join(
        catalog.select("sheet", F.col("column_name").alias("metric")), ["sheet", "metric"], "left_anti"
    )
    message = F.when(
        F.col("metric").isNull(),
        F.format_string("Sheet '%s' isn't in this file and will be skipped.", "sheet"),
    ).otherwise(F.format_string(
        "'%s' isn't a column in sheet '%s', so it won't be forecast there.", "metric", "sheet"
    ))
    return (
        absent.unionByName(lacking)
        .withColumn("code", F.lit("metric_missing_in_sheet"))
        .withColumn("severity", F.lit("warning"))
        .withColumn("message", message)
    )


def covariate_columns(
    sheet: DataFrame, wanted: Sequence[str], metric: str, other: DataFrame | None = None
) -> tuple[DataFrame | None, str | None, list[str]]:
    """Where the wanted covariates come from: the second table when it holds any,
    else the sheet itself without the metric. Returns (table, date column, names)."""
    if other is not None:
        names = [c for c in wanted if c in other.columns]
        if names:
            date_col = next((c for c in other.columns if "date" in c.lower()), None)
            return other, date_col, names
    names = [c for c in wanted if c in sheet.columns and c != metric]
    if names:
        return sheet, infer_date_column(sheet), names
    return None, None, []
