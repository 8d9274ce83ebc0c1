"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from seriesloom.llm.common import load
from seriesloom.llm.registry import query
from seriesloom.session import scratch_folder


def text_bytes(text="text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffle_into_shards(df: DataFrame, folder: str, shards: int = 24, seed: int = 20, bucket_bytes: int = 128 << 20,
                        key: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Write all rows of ``df``, in a seeded uniform order, as ``shards`` Parquet folders whose row
    counts differ by one at most, and return them as read back.

    Pass one scatters rows into buckets of about ``bucket_bytes`` by a seeded hash of ``key``. Pass two
    Fisher-Yates shuffles each bucket: a permutation of the bucket's row numbers is drawn and the rows
    are sorted to it, so only the numbers, never the rows, have to fit in memory. Buckets laid end to
    end give every row its place; shard ``s`` holds places ``s*n//shards`` up to the next shard's first.

    Returns ``record`` (all columns of ``df``, so no name can clash), ``shard`` int and ``slot`` long,
    gapless from 0 in each shard. Nulls hash like any value; rows equal in ``key`` share a bucket and
    keep their number; an empty table gives an empty result.
    """
    spark = df.sparkSession
    place = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in key])
    rows, size = df.agg(F.count(F.lit(1)), F.sum(text_bytes())).first()
    buckets = max(math.ceil((size or 0) / bucket_bytes), int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = dict(df.groupBy(F.pmod(place, F.lit(buckets)).alias("b")).count().collect())  # one row a bucket
    starts = [0, *accumulate(counts.get(b, 0) for b in range(buckets))]
    shared = spark.sparkContext.broadcast(np.array(starts, dtype=np.int64))
    drawn: dict[int, np.ndarray] = {}

    @pandas_udf("long")
    def fisher_yates(bucket: pd.Series, number: pd.Series) -> pd.Series:
        out = np.empty(len(bucket), dtype=np.int64)
        of, nth, first = bucket.to_numpy(), number.to_numpy(), shared.value
        for b in np.unique(of):
            if b not in drawn:
                drawn.clear()  # a task meets its buckets one after the other
                drawn[b] = np.random.default_rng([seed, int(b)]).permutation(first[b + 1] - first[b])
            at = of == b
            out[at] = first[b] + drawn[b][nth[at] - 1]
        return pd.Series(out)

    numbered = (df.select(F.struct("*").alias("record"), place.alias("_h"))
                .withColumn("_b", F.pmod("_h", F.lit(buckets))).repartition(buckets, "_b")
                .withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_h"))))
    at = fisher_yates("_b", "_i")
    shard = F.expr(f"((_g + 1) * {shards} - 1) div {max(rows, 1)}")
    placed = (numbered.withColumn("_g", at).withColumn("shard", shard.cast("int"))
              .withColumn("slot", F.col("_g") - F.expr(f"(cast(shard as long) * {rows}) div {shards}"))
              .select("record", "shard", "slot"))
    (placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard")
     .option("compression", "zstd").parquet(folder))
    return spark.read.schema(placed.schema).parquet(folder)


@query("op2_shards")
def op2(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    out = shuffle_into_shards(docs, scratch_folder(spark, "shards"))
    text = F.coalesce("record.text", F.lit(""))
    return out.select("record.doc_id", (text_bytes("record.text") + 8).alias("size"),
                      F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
