"""Removal of lines that repeat in windows of three."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import load, stored
from seriesloom.llm.registry import query


def remove_repeated_lines(df: DataFrame, width: int = 3) -> DataFrame:
    """One row per row of ``df``: ``record`` (all its columns), ``kept`` (the remaining text), ``n_lines``,
    ``n_removed``.

    Lines end at ``\\n``. Every ``width`` consecutive lines form a window, and windows overlap. Of windows
    with the same lines, the first in the order of doc_id and position stays; each later one covers its
    lines, and every covered line goes, however many windows cover it.

    A window travels as two 64-bit hashes and its place. The first place is a partial aggregate, so a
    window found in a third of all documents is one row on that side of the join, whose other side may
    be split. Texts of fewer than ``width`` lines have no window and stay whole; an empty text is one
    empty line; a null text stays null with 0 lines. Rows without doc_id come first. Rows with the same
    doc_id come in the order of a hash of their text; of rows that agree in both, one is the first and the others, all whose
    windows came before, lose every line if they have ``width``.
    """
    docs = df.select(F.struct("*").alias("record"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"),
                     F.split("text", "\n", -1).alias("_lines"))
    hashes = [f"xxhash64({seed}, slice(_lines, i + 1, {width}))" for seed in (0, 1)]
    windows = stored(
        docs.where(F.size("_lines") >= width)
        .select("_id", "_th", F.posexplode(F.expr(
            f"transform(sequence(0, size(_lines) - {width}), i -> struct({hashes[0]} AS a, {hashes[1]} AS b))")).alias("at", "w"))
        .select("_id", "_th", "at", "w.a", "w.b"), "line-windows")
    place = F.struct("_id", "_th", "at")
    repeated = (windows.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                .where("n > 1").drop("n"))
    starts = (windows.join(repeated, ["a", "b"]).where(place > F.col("first"))
              .groupBy("_id", "_th").agg(F.collect_set("at").alias("starts"))
              .toDF("_did", "_dth", "_starts"))
    same = F.col("_id").eqNullSafe(F.col("_did")) & F.col("_th").eqNullSafe(F.col("_dth"))
    again = stored(df.where("text is not null").select("doc_id", F.xxhash64("text").alias("th")).groupBy("doc_id", "th")
                   .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_did"), F.col("th").alias("_dth")), "repeated-rows")
    once = docs.join(again, same, "left_anti").withColumn("_nth", F.lit(1))
    joined = once.unionByName(_numbered(docs.join(again, same, "left_semi"))).join(starts, same, "left")
    # Kept line numbers by set difference, in time linear in lines and windows.
    steps = ", ".join(f"s + {k}" for k in range(width))
    kept = F.expr(f"""CASE WHEN _nth > 1 AND size(_lines) >= {width} THEN array() WHEN _starts IS NULL THEN NULL ELSE array_except(sequence(0, size(_lines) - 1),
        flatten(transform(_starts, s -> array({steps})))) END""")
    n_lines = F.when(F.col("record.text").isNull(), 0).otherwise(F.size("_lines"))
    return (joined.withColumn("_kept", kept)
            .select("record",
                    F.when(F.col("_kept").isNull(), F.col("record.text"))
                    .otherwise(F.array_join(F.expr("transform(_kept, i -> _lines[i])"), "\n")).alias("kept"),
                    n_lines.cast("long").alias("n_lines"),
                    F.when(F.col("_kept").isNull(), 0).otherwise(n_lines - F.size("_kept")).cast("long").alias("n_removed")))


def _numbered(rows: DataFrame, salts: int = 64) -> DataFrame:
    """``_nth``: 1 for one of the rows that agree in ``_id`` and ``_th``, more for the others. Such a group is dealt to salts, and
    only the first row of each salt meets those of the others, so no task holds a large group."""
    key = ["_id", "_th"]
    dealt = rows.withColumn("_salt", F.floor(F.rand(8) * salts))
    dealt = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_salt").orderBy(F.lit(0))))
    dealt = dealt.withColumn("_set", F.when(F.col("_n") == 1, F.lit(-1)).otherwise(F.col("_salt")))
    dealt = dealt.withColumn("_m", F.row_number().over(Window.partitionBy(*key, "_set").orderBy("_salt")))
    return dealt.withColumn("_nth", F.when((F.col("_set") == -1) & (F.col("_m") == 1), 1).otherwise(2)).select(*rows.columns, "_nth")


@query("op8_line_windows", """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS doc, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc, unnest(range(len(l) - 2)) AS pos, l FROM d WHERE len(l) >= 3),
k AS (SELECT doc, pos, row_number() OVER (PARTITION BY l[pos + 1], l[pos + 2], l[pos + 3] ORDER BY doc, pos) AS nth FROM w),
c AS (SELECT DISTINCT doc, pos + unnest([0, 1, 2]) AS pos FROM k WHERE nth > 1),
x AS (SELECT doc, list(pos) AS gone FROM c GROUP BY doc)
SELECT d.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  md5(CASE WHEN gone IS NULL THEN text ELSE array_to_string(
    list_filter(l, lambda y, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_md5
FROM d LEFT JOIN x ON x.doc = d.doc
""")
def op8(spark, sf_dir):
    out = remove_repeated_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("record.doc_id", "n_lines", "n_removed", F.md5(F.col("kept").cast("binary")).alias("kept_md5"))
