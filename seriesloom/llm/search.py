"""Exact search for the greatest inner products in norm order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, in_batches, load, stored
from seriesloom.llm.registry import query

HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
VECTOR = pa.schema([("vec_id", pa.int64()), ("x", pa.binary()), ("norm", pa.float64())])
EXACT = 2.0**53  # sums of integers below this are exact in doubles
LEAST, MOST = -(2**63), 2**63 - 1
ROWS = 512  # candidates that are bounded together
DENSE = 0.02  # share of pairs from which on all are multiplied at once


def integer_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``x`` (floor(scale * component) as doubles), ``norm``; rows that agree in both are one.
    Left out are vectors that are null, hold null or non-finite components, or have no vec_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for vec_id, v in zip(*columns(batch, "vec_id", "embedding")):
                    if v is None or None in v:
                        continue
                    x = np.floor(scale * np.array(v, dtype=np.float64))
                    if np.isfinite(x).all():
                        yield vec_id, x.astype("<f8").tobytes(), float(np.sqrt((x * x).sum()))
        with np.errstate(over="ignore"):
            yield from in_batches(rows(), VECTOR)
    return (df.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
            .mapInArrow(run, "vec_id long, x binary, norm double").dropDuplicates(["vec_id", "x"]))


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors as the rows of a matrix, shorter ones filled up with zeros."""
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        v = np.frombuffer(r, "<f8")
        out[k, :len(v)] = v
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows of integers, kept within the range of a long."""
    top = float(np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1])
    if top < EXACT:
        return (a * b).sum(axis=1).astype(np.int64)
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(p, q)), LEAST), MOST) for p, q in zip(a, b)], dtype=np.int64)


class Best:
    """The k best candidates so far of every query, each vec_id with its best score, ties to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.k, self.ids = k, ids
        self.query = np.empty(0, np.int64)
        self.vec = np.empty(0, np.int64)
        self.score = np.empty(0, np.int64)
        self.least = np.full(len(ids), -np.inf)  # the k-th best score

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        q, v, s = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((v, -s.astype(object) if (s == LEAST).any() else -s, q))
        q, v, s = q[order], v[order], s[order]
        fresh = np.ones(len(q), dtype=bool)
        by_vec = np.lexsort((np.arange(len(q)), v, q))  # the first row of each query and vec_id has its best score
        fresh[by_vec[1:]] = (q[by_vec[1:]] != q[by_vec[:-1]]) | (v[by_vec[1:]] != v[by_vec[:-1]])
        q, v, s = q[fresh], v[fresh], s[fresh]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        keep = nth < self.k
        self.query, self.vec, self.score = q[keep], v[keep], s[keep]
        full = q[nth == self.k - 1]
        self.least[full] = np.maximum(self.least[full], s[nth == self.k - 1])


def scan(best: Best, q: np.ndarray, q_turned: np.ndarray, vec_id: np.ndarray, x: np.ndarray, x_turned: np.ndarray,
         steps: list[int]) -> None:
    """Meet candidates with queries, longest candidates first.

    A query is done with once |q| * |x| falls below its k-th best score. Else the product over the first
    rotated components plus the product of the lengths of the rest (Cauchy-Schwarz) bounds the score; pairs that
    may still reach the k-th best go on to more components, the rest to none. What is left is multiplied
    exactly, in integers.
    """
    q_rest = np.stack([np.sqrt((q_turned[:, s:] ** 2).sum(axis=1)) for s in [0, *steps]])
    x_rest = np.stack([np.sqrt((x_turned[:, s:] ** 2).sum(axis=1)) for s in [0, *steps]])
    order = np.argsort(-x_rest[0], kind="stable")
    for at in range(0, len(order), ROWS):
        rows = order[at:at + ROWS]
        slack = 1e-9 * q_rest[0] * x_rest[0, rows[0]] + 1e-6
        active = np.flatnonzero(q_rest[0] * x_rest[0, rows[0]] >= best.least - slack)
        if not len(active):
            return
        need = best.least[active] - slack[active]
        # All pairs while many are left, then pair by pair.
        part = np.zeros((len(active), len(rows)))
        done = 0
        for k, e in enumerate(steps):
            part += q_turned[active, done:e] @ x_turned[rows, done:e].T
            done = e
            may = part + np.outer(q_rest[k + 1, active], x_rest[k + 1, rows]) >= need[:, None]
            if may.sum() < DENSE * may.size:
                break
        a, b = np.nonzero(may)
        part = part[a, b]
        for k in range(k + 1, len(steps)):
            s, e = steps[k - 1], steps[k]
            part = part + np.einsum("ij,ij->i", q_turned[active[a], s:e], x_turned[rows[b], s:e])
            still = part + q_rest[k + 1, active[a]] * x_rest[k + 1, rows[b]] >= need[a]
            a, b, part = a[still], b[still], part[still]
        other = best.ids[active[a]] != vec_id[rows[b]]
        a, b = active[a[other]], rows[b[other]]
        for c in range(0, len(a), 1 << 16):
            p, r = a[c:c + (1 << 16)], b[c:c + (1 << 16)]
            best.add(p, vec_id[r], inner(q[p], x[r]))


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, lead: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query (``vec_id, x, norm``) the ``k`` candidates of ``vectors`` with
    the greatest inner products, ties to the smaller vec_id, its own vec_id left out; all, if fewer.

    Vectors are range-partitioned by descending length and stored. Second moments summed in Spark give the
    rotation (singular vectors) that packs most of an inner product into the first components. Queries pass in
    blocks of ``block``, each one broadcast and held against all partitions; the ``lead`` longest vectors set a
    first bound for a block, every partition sends at most ``k`` rows a query, and a window ranks them. Vectors
    of different widths are filled up with zeros. If a vec_id has several vectors, its best score counts.
    """
    spark = vectors.sparkSession
    width = max(int(vectors.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8, 1)
    index = stored(vectors.repartitionByRange(F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm")), "norm-order")
    turn = rotation(index, width)
    longest = index.orderBy(F.desc("norm"), "vec_id").limit(lead).collect()
    lead_x, lead_id = matrix([r.x for r in longest], width), np.array([r.vec_id for r in longest], dtype=np.int64)
    steps = sorted({max(1, width // 4), max(1, width // 2), max(1, 3 * width // 4), width})

    def answers(rows: list) -> DataFrame:
        ids = np.array([r.vec_id for r in rows], dtype=np.int64)
        q = matrix([r.x for r in rows], width)
        first = Best(ids, k)
        if len(lead_x):
            scan(first, q, q @ turn, lead_id, lead_x, lead_x @ turn, steps)
        shared = spark.sparkContext.broadcast((ids, q, turn, first.least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, turn, least = shared.value
            best, q_turned = Best(ids, k), q @ turn
            best.least = least.copy()
            for batch in batches:
                vec_id, x = columns(batch, "vec_id", "x")
                x = matrix(x, width)
                scan(best, q, q_turned, np.array(vec_id, dtype=np.int64), x, x @ turn, steps)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.query]), pa.array(best.vec), pa.array(best.score)], schema=HIT)
        return index.select("vec_id", "x").mapInArrow(run, "query_id long, vec_id long, score long")

    hits, held = None, []
    for r in queries.select("vec_id", "x").toLocalIterator():
        held.append(r)
        if len(held) == block:
            hits, held = answers(held) if hits is None else hits.union(answers(held)), []
    if held:
        hits = answers(held) if hits is None else hits.union(answers(held))
    if hits is None:
        hits = spark.createDataFrame([], "query_id long, vec_id long, score long")
    one = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all vectors, greatest first, from their summed second moments. Vectors are
    scaled by their length for it; any rotation gives the same answers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("x").to_pylist(), width)
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "v"])
    cells = vectors.select("x").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros(width * width)
    for r in cells:
        moments[r.cell] = r.v
    return np.linalg.svd(moments.reshape(width, width))[2].T


@query("op5_top_products", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op5(spark, sf_dir):
    vectors = integer_vectors(load(spark, sf_dir, "embeddings"))
    return top_products(vectors, vectors.where("vec_id % 50 = 0"))
