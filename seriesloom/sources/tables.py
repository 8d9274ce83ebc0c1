"""Multi-sheet datasets: several tables of one workbook as one DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seriesloom.operators.typing import infer_date_column


def combine_sheets(sheets: dict[str, DataFrame]) -> DataFrame:
    """All sheets in one table with a ``sheet`` column; a column a sheet lacks is null."""
    if not sheets:
        raise ValueError("no sheets given")
    tagged = [df.withColumn("sheet", F.lit(name)) for name, df in sheets.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def dataset_catalog(sheets: dict[str, DataFrame]) -> DataFrame:
    """Sheets that have a date column: (sheet, row_count, date_column, columns).
    A dataset without any is rejected."""
    kept = {name: (df, infer_date_column(df)) for name, df in sheets.items()}
    kept = {name: pair for name, pair in kept.items() if pair[1] is not None}
    if not kept:
        raise ValueError("No sheet contains a date column.")
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("sheet"), "row_count", F.lit(date_col).alias("date_column"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"))
        for name, (df, date_col) in kept.items()
    ]
    return reduce(DataFrame.unionByName, counts)
