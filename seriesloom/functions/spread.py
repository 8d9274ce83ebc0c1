"""Building blocks for keys that may hold a large share of all rows.

A daily series is bounded by the calendar, so windows over one series are safe.
Raw readings are not: one sensor may send most of the data. The functions here
keep such a key spread over many tasks, and give the same result as the plain form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from seriesloom.functions.timecols import micros

SALTS = 16


def join_facts(
    rows: DataFrame, facts: DataFrame, key: Sequence[str], spread_by: Sequence[str],
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """Join rows with facts (one row per key) without sending a hot key to one task.

    Each row goes to one of ``salts`` copies of its key's fact row, chosen by a
    hash of ``spread_by`` (columns that differ between a key's rows). Catalyst
    still broadcasts the copies when their size is under its threshold: they come
    from a cross join, which its estimate counts, while an explode counts as one row.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    numbers = facts.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt"))
    copies = facts.crossJoin(F.broadcast(numbers))
    return salted.join(copies, [*key, "_salt"], how).drop("_salt")


def exact_percentiles(
    rows: DataFrame, key: Sequence[str], value: str, wanted: dict[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolated percentiles per key; one output column per entry.

    A bounded sketch brackets each wanted rank; only values inside a bracket are
    ranked, so no task ever holds a key's full set of values. Keys with at most
    ``accuracy`` values are ranked whole.
    """
    key = list(key)
    slack = 4.0 / accuracy
    names = list(wanted)
    marks: list[float] = []
    for p in wanted.values():
        marks += [max(0.0, p - slack), min(1.0, p + slack)]
    present = rows.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("_v"))
    # equal values are merged first, so copies of one reading cost one row
    counted = present.groupBy(*key, "_v").agg(F.count("*").alias("_c"))
    sketch = present.groupBy(*key).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", marks, accuracy).alias("_marks"),
    )
    small = F.col("_n") <= accuracy
    brackets = sketch.select(
        *key, "_n",
        F.explode(F.array(*[
            F.struct(
                F.lit(i).alias("i"),
                F.lit(float(wanted[name])).alias("p"),
                F.when(small, F.col("_min")).otherwise(F.col("_marks")[2 * i]).alias("lo"),
                F.when(small, F.col("_max")).otherwise(F.col("_marks")[2 * i + 1]).alias("hi"),
            )
            for i, name in enumerate(names)
        ])).alias("_b"),
    ).select(*key, "_n", "_b.*")
    placed = join_facts(counted, brackets, key, ["_v"])
    below = placed.where(F.col("_v") < F.col("lo")).groupBy(*key, "i").agg(F.sum("_c").alias("_below"))
    inside = placed.where(F.col("_v").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy(*key, "i").orderBy("_v")
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        inside.withColumn("_upto", upto)
        .join(below, [*key, "i"], "left")
        .withColumn("_last", F.col("_upto") + F.coalesce("_below", F.lit(0)) - 1)
        .withColumn("_first", F.col("_last") - F.col("_c") + 1)
    )
    target = F.col("p") * (F.col("_n") - 1)
    low_rank, high_rank = F.floor(target), F.ceil(target)
    picked = ranked.groupBy(*key, "i").agg(
        F.max(F.when(low_rank.between(F.col("_first"), F.col("_last")), F.col("_v"))).alias("_lo_v"),
        F.max(F.when(high_rank.between(F.col("_first"), F.col("_last")), F.col("_v"))).alias("_hi_v"),
        F.first(target - low_rank).alias("_part"),
    )
    result = F.col("_lo_v") + (F.col("_hi_v") - F.col("_lo_v")) * F.col("_part")
    return picked.groupBy(*key).agg(*[
        F.max(F.when(F.col("i") == i, result)).alias(name) for i, name in enumerate(names)
    ])


def previous_reading(
    rows: DataFrame, key: Sequence[str], order: str, carried: Sequence[str],
    prefix: str = "prev_", target_rows: int = 1_000_000,
) -> DataFrame:
    """``lag`` of ``carried`` by ``order`` within each key, for keys of any size.

    A key's time span is cut into pieces of about ``target_rows`` rows. Each piece
    is sorted on its own; the last row of a piece is handed to the next piece that
    has rows, so the first row there sees its true predecessor.
    """
    key = list(key)
    span = rows.groupBy(*key).agg(
        F.count("*").alias("_n"),
        F.min(micros(F.col(order))).alias("_from"),
        F.max(micros(F.col(order))).alias("_to"),
    )
    pieces = F.ceil(F.col("_n") / F.lit(target_rows))
    width = F.greatest(F.lit(1), F.ceil((F.col("_to") - F.col("_from") + 1) / pieces))
    cut = (
        join_facts(rows, span, key, [order])
        .withColumn("_piece", F.floor((micros(F.col(order)) - F.col("_from")) / width))
        .drop("_n", "_from", "_to")
        .withColumn("_handed", F.lit(False))
    )
    ends = cut.groupBy(*key, "_piece").agg(
        F.max_by(F.struct(*cut.columns), F.col(order)).alias("_row")
    )
    by_piece = Window.partitionBy(*key).orderBy("_piece")
    handed = (
        ends.withColumn("_next", F.lead("_piece").over(by_piece))
        .where(F.col("_next").isNotNull())
        .select("_next", "_row.*")
        .withColumn("_piece", F.col("_next")).drop("_next")
        .withColumn("_handed", F.lit(True))
    )
    local = Window.partitionBy(*key, "_piece").orderBy(order)
    both = cut.unionByName(handed)
    for name in carried:
        both = both.withColumn(prefix + name, F.lag(name).over(local))
    return both.where(~F.col("_handed")).drop("_piece", "_handed")
