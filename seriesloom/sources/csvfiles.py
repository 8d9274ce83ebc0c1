"""CSV files whose encoding is not known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

# Encodings in the order they are tried, with Spark's names for them.
ENCODINGS = ("UTF-8", "windows-1252", "ISO-8859-1")
# Bytes that windows-1252 leaves undefined.
UNDEFINED_BYTES = ("81", "8D", "8F", "90", "9D")


def detect_encodings(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_path, encoding, header) per file: the first encoding that decodes every line, and
    the bytes of its first line.

    Lines are read as raw bytes and checked where they lie, so a file of any size is
    split over tasks and never held whole.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file_path"), "value", place.alias("place"))
    undefined = F.hex(F.col("value").cast("binary")).rlike("^(?:..)*(?:" + "|".join(UNDEFINED_BYTES) + ")")
    facts = lines.groupBy("file_path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("_utf8"), F.bool_or(undefined).alias("_undefined"),
        F.min_by(F.hex(F.col("value").cast("binary")), "place").alias("header"))
    return facts.select("file_path", "header", F.when(F.col("_utf8"), ENCODINGS[0]).when(~F.col("_undefined"), ENCODINGS[1])
                        .otherwise(ENCODINGS[2]).alias("encoding"))


def read_csv(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """CSV files as text columns, each file in its own encoding and with its own header:
    columns meet by name, and one that a file lacks is null there. ``file_path``,
    ``block_start`` and ``line_id`` keep the file order for keep-last rules."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    alike: dict[tuple[str, str], list[str]] = {}
    for r in detect_encodings(spark, paths).collect():
        alike.setdefault((r["encoding"], r["header"]), []).append(r["file_path"])
    frames = []
    for encoding, header in sorted(alike):
        raw = spark.read.options(header="true", encoding=encoding, **options).csv(alike[encoding, header])
        frames.append(raw.select(
            *raw.columns, F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_id")))
    if not frames:
        raise ValueError(f"no CSV lines in {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_dataset(spark: SparkSession, sheets: dict[str, str]) -> dict[str, DataFrame]:
    """Sheet name to table. A sheet is a .csv or .parquet path; anything else is refused."""
    out = {}
    for name, path in sheets.items():
        if path.endswith(".csv"):
            out[name] = read_csv(spark, [path])
        elif path.endswith(".parquet"):
            out[name] = spark.read.parquet(path)
        else:
            raise ValueError(f"Unsupported file type: {path}")
    return out
