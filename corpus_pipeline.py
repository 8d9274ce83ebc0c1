"""A training-data pipeline over ``documents``: five stages, each stored before the next reads it.

In every stage a null or empty text, or one without letters, goes with the first stage; texts of any length are taken whole; rows
that agree in doc_id, text or both are rows of their own until the near stage keeps one of each group; an empty table gives
empty results with the same columns; further columns of ``documents`` are left behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import load, stored
from seriesloom.llm.language import UNDETERMINED, identify, remainder, train
from seriesloom.llm.leaks import find_leaks
from seriesloom.llm.lines import remove_repeated_lines
from seriesloom.llm.near import near_duplicates
from seriesloom.llm.packing import pack, tokenized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5  # below it no language has most of the likelihood: not prose of a language that was learned

#: Not expressible in SQL: the stages use tokenizers, alignments and a fitted model.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told; ``und`` and undecided ones go. The label becomes the prediction."""
    found = identify(docs, train(docs.where(remainder() != 2)), records=True)
    return (found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
            .select("record.doc_id", "record.text", F.col("lang_pred").alias("lang"), "record.source", "record.n_chars"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of repeated three-line windows; a document that loses all its lines goes."""
    out = remove_repeated_lines(docs)
    return (out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
            .select("record.doc_id", F.col("kept").alias("text"), "record.lang", "record.source",
                    F.length("kept").cast("long").alias("n_chars")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate group, at a similarity of 0.8, the row with the smallest doc_id (of equal ids one; a row
    without doc_id only where all lack it)."""
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("row"), *COLUMNS), "numbered")
    found = stored(near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), percent=80)
                   .select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = found.join(numbered.select("row", "doc_id"), "row").groupBy("group").agg(F.min(order).alias("first"))
    gone = stored(found.join(first, "group").where(F.col("row") != F.col("first.row")).select("row"), "copies")
    return numbered.join(gone, "row", "left_anti").select(*COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, copied or edited."""
    found = stored(find_leaks(docs, load(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, docs.doc_id.eqNullSafe(found.doc_id), "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of 2048: one row per piece, with its ids' checksum."""
    pieces = pack(tokenized(docs, "word_bpe_49k.json", "word", 1))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("lines", lines), ("near", near), ("leaks", leaks), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
