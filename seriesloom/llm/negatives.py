"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited by their score bounds."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, in_batches, load, stored
from seriesloom.llm.registry import query
from seriesloom.llm.search import inner, matrix

PARTS = 4096  # at most, of the index; together with 256 * 256 cells they bound the directory that is broadcast
CODES = 256
ROWS = 5000  # of the index in a group
ANCHORS = 2048  # in a group

VECTOR = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary())])
CODED = pa.schema([*VECTOR, ("i", pa.int32()), ("j", pa.int32()), ("r1", pa.float64()), ("r2", pa.float64())])
ROUTE = pa.schema([("part", pa.int32()), ("anchor", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("x", pa.binary()),
                   ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("need", pa.list_(pa.float64()))])
HIT = pa.schema([("anchor", pa.int64()), ("k", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
ROUTE_DDL = "part int, anchor long, vec_id long, label long, x binary, low array<double>, high array<double>, need array<double>"


def labelled_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id``, ``label``, ``x`` (floor(scale * component) as doubles); rows that agree in all three are one. Left
    out are rows without vec_id or label and vectors that are null or hold null or non-finite components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            with np.errstate(over="ignore"):
                for batch in batches:
                    for vec_id, label, v in zip(*columns(batch, "vec_id", "label", "embedding")):
                        if v is not None and None not in v:
                            x = np.floor(scale * np.array(v, dtype=np.float64))
                            if np.isfinite(x).all():
                                yield vec_id, label, (x + 0.0).astype("<f8").tobytes()
        yield from in_batches(rows(), VECTOR)
    return (df.where("vec_id is not null and label is not null")
            .select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
            .mapInArrow(run, "vec_id long, label long, x binary").dropDuplicates(["vec_id", "label", "x"]))


def codebook(points: np.ndarray, codes: int, rounds: int = 10) -> np.ndarray:
    """Centroids of ``points`` by k-means from evenly spaced points; any centroids give the same answers."""
    centres = points[np.linspace(0, len(points) - 1, min(codes, len(points))).astype(int)].copy() if len(points) else np.zeros((1, points.shape[1]))
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        count = np.bincount(nearest, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, nearest, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    if not len(points):
        return np.empty(0, np.int64)
    return ((centres * centres).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


class Cells:
    """The rows of one group of the index by cell, visited for an anchor in the order of their bounds.

    A row of cell (i, j) has at most the score ``u1[i] + u2[j]``, where a half's bound is the anchor's product
    with the centroid plus its length times the greatest distance of this group's rows from that centroid."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], width: int, vec_id: np.ndarray, label: np.ndarray, x: list[bytes],
                 i: np.ndarray, j: np.ndarray, r1: np.ndarray, r2: np.ndarray):
        order = np.lexsort((vec_id, j, i))
        self.vec_id, self.label, self.x = vec_id[order], label[order], matrix([x[k] for k in order], width)
        self.longest = math.sqrt(float((self.x * self.x).sum(axis=1).max(initial=0)))
        i, j = i[order], j[order]
        first = np.concatenate([[0], np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1]) if len(i) else np.empty(0, int)
        ends = np.concatenate([first[1:], [len(i)]]) if len(i) else first
        self.rows = {(int(i[a]), int(j[a])): (int(a), int(b)) for a, b in zip(first, ends)}
        self.codes, self.centres, self.radii = [], [], []
        for code, r, book in ((i, r1[order], books[0]), (j, r2[order], books[1])):
            used, place = np.unique(code, return_inverse=True)
            radius = np.zeros(len(used))
            np.maximum.at(radius, place, r)
            self.codes.append(used)
            self.centres.append(book[used])
            self.radii.append(radius)

    def visit(self, a: np.ndarray) -> Iterator[tuple[float, float, int, int]]:
        """(upper bound, lower bound, first row, end) of every cell, greatest upper bound first. The two halves' lists are
        merged by a heap: a pair is pushed when its neighbour before it in either list has been popped."""
        half = self.centres[0].shape[1]
        upper, lower, codes = [], [], []
        for part, centres, radii, used in zip((a[:half], a[half:]), self.centres, self.radii, self.codes):
            middle, reach = centres @ part, radii * math.sqrt(float(part @ part))
            order = np.argsort(-(middle + reach), kind="stable")
            upper.append((middle + reach)[order].tolist())
            lower.append((middle - reach)[order].tolist())
            codes.append(used[order].tolist())
        if not self.rows:
            return
        heap, pushed = [(-(upper[0][0] + upper[1][0]), 0, 0)], {(0, 0)}
        while heap:
            bound, p, q = heapq.heappop(heap)
            cell = self.rows.get((codes[0][p], codes[1][q]))
            if cell is not None:
                yield -bound, lower[0][p] + lower[1][q], *cell
            for n in ((p + 1, q), (p, q + 1)):
                if n[0] < len(upper[0]) and n[1] < len(upper[1]) and n not in pushed:
                    pushed.add(n)
                    heapq.heappush(heap, (-(upper[0][n[0]] + upper[1][n[1]]), *n))

    def windows(self, a: np.ndarray, own: int, label: int, same: bool, low: list[float], high: list[float], need: list[float],
                k: int) -> list[list[tuple[int, int]]]:
        """For each window [low, high] of scores the ``k`` best (score, vec_id) of rows with the anchor's label (``same``) or with
        another, ties to the smaller vec_id. A window is certified once the bound of all cells left is below its k-th
        best score or its ``need``; the visit stops when all are."""
        found: list[list[tuple[int, int]]] = [[] for _ in low]
        need = [max(n, lo) for n, lo in zip(need, low)]
        top = max(high)
        slack = 1e-9 * math.sqrt(float(a @ a)) * self.longest + 1e-6
        for bound, least, first, end in self.visit(a):
            goal = min(need)
            if bound + slack < goal:
                break
            if least - slack > top:
                continue
            score = inner(np.broadcast_to(a, (end - first, len(a))), self.x[first:end])
            fits = ((self.label[first:end] == label) == same) & (self.vec_id[first:end] != own) & (score >= goal) & (score <= top)
            if not fits.any():
                continue
            score, vec_id = score[fits], self.vec_id[first:end][fits]
            for w in range(len(low)):
                inside = (score >= need[w]) & (score <= high[w])
                if inside.any():
                    found[w] = sorted([*found[w], *zip(score[inside].tolist(), vec_id[inside].tolist())], key=lambda r: (-r[0], r[1]))[:k]
                    if len(found[w]) == k:
                        need[w] = max(need[w], found[w][-1][0])
        return found


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
                   sample: int = 10_000) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` and ``anchors`` (some of the same rows) come from :func:`labelled_vectors`; scores are inner products,
    higher ones first, ties to the smaller vec_id. An anchor's positives are its ``positives`` best rows of the same
    label but itself. For each positive: the ``negatives`` best rows of other labels with
    ``least`` * positive score <= 100 * score <= ``most`` * positive score. All, if there are fewer.

    - Two codebooks, one for each half of the components, are fitted by k-means on at most about ``sample`` rows
      (the bound); every row is indexed under its cell, with its distances from both centroids. The number of codes is
      the fourth root of the number of rows, so cells and rows a cell grow alike.
    - The index is range-partitioned by cell, which splits a large cell, and cut into groups of about ``ROWS`` rows.
      A directory (part, cell, radii), bounded by ``PARTS`` and ``CODES``, is broadcast.
    - An anchor first goes to the part with the greatest bound, which gives thresholds, then to every other part whose
      bound reaches them. Anchors meet a group in blocks; each group's cells are visited by a heap over both
      halves' bounds until the windows are certified (:class:`Cells`). So answers are exact.

    Rows under one vec_id that differ in vector or label are candidates and anchors of their own; rows with an
    anchor's vec_id are never its candidates. Shorter vectors are filled up with zeros. An anchor without positives, or a
    positive without rows in its window (as with a negative score), gives no row; empty tables give an empty result.
    Windows are exact for scores below 2**53.
    """
    spark = vectors.sparkSession
    vectors = stored(vectors, "labelled")
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
    width = max((facts.bytes or 0) // 8, 1)
    half = width // 2
    share = min(1.0, sample / max(facts.n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("vec_id", "x", F.lit(11)), F.lit(1 << 20)) < int(share * (1 << 20))).select("x")
    fit = matrix([bytes(r.x) for r in chosen.toLocalIterator()], width)
    codes = min(CODES, max(2, math.ceil(facts.n ** 0.25)))
    books = codebook(fit[:, :half], codes), codebook(fit[:, half:], codes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x").to_pylist(), width)
            out = []
            for part, book in ((x[:, :half], books[0]), (x[:, half:], books[1])):
                code = _nearest(part, book)
                out += [code.astype(np.int32), np.sqrt(((part - book[code]) ** 2).sum(axis=1))]
            i, r1, j, r2 = (pa.array(c) for c in out)
            yield pa.RecordBatch.from_arrays([*batch.columns, i, j, r1, r2], schema=CODED)

    coded = vectors.mapInArrow(assign, "vec_id long, label long, x binary, i int, j int, r1 double, r2 double")
    parts = min(PARTS, max(1, math.ceil(facts.n / ROWS)))
    index = coded.repartitionByRange(parts, "i", "j", "vec_id", F.xxhash64("x", "label")).withColumn("part", F.spark_partition_id())
    index = stored(index, "cells")
    groups = F.ceil(F.sum("n").over(Window.partitionBy("part")) / ROWS).cast("int").alias("subs")
    directory = index.groupBy("part", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2"))
    cells = stored(directory.select("part", "i", "j", "r1", "r2", groups), "directory")
    subs = cells.select("part", "subs").distinct()
    index = index.join(F.broadcast(subs), "part").withColumn("sub", F.pmod(F.xxhash64("vec_id", "x"), F.col("subs")).cast("int")).drop("subs")
    listed = spark.sparkContext.broadcast(tuple(np.array(c) for c in zip(*cells.select("part", "i", "j", "r1", "r2").toLocalIterator())))

    def route(lead: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                if not listed.value:
                    return
                part, i, j, r1, r2 = listed.value
                ids, first = np.unique(part, return_index=True)
                order = np.argsort(part, kind="stable")
                first = np.searchsorted(part[order], ids)
                for batch in batches:
                    for anchor, vec_id, label, x, low, high, need in zip(*columns(batch, "anchor", "vec_id", "label", "x", "low", "high", "need")):
                        a = matrix([x], width)[0]
                        a1, a2 = a[:half], a[half:]
                        n1, n2 = math.sqrt(float(a1 @ a1)), math.sqrt(float(a2 @ a2))
                        bound = (books[0] @ a1)[i] + n1 * r1 + (books[1] @ a2)[j] + n2 * r2
                        best = np.maximum.reduceat(bound[order], first)
                        front = int(best.argmax())
                        goal = min(max(n, lo) for n, lo in zip(need, low))
                        wanted = [front] if lead else np.flatnonzero(best * (1 + 1e-9) + 1e-3 >= goal).tolist()
                        for p in wanted:
                            if lead or p != front:
                                yield int(ids[p]), anchor, vec_id, label, x, low, high, need
            yield from in_batches(rows(), ROUTE, 500)
        return run

    def look(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The k best of every window over the whole index: (anchor, k, vec_id, score, rank)."""
        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            i, j, r1, r2, vec_id, label = (right.column(n).to_numpy() for n in ("i", "j", "r1", "r2", "vec_id", "label"))
            group = Cells(books, width, vec_id, label, right.column("x").to_pylist(), i, j, r1, r2)
            out = []
            for anchor, own, label, x, low, high, need in zip(*columns(left, "anchor", "vec_id", "label", "x", "low", "high", "need")):
                for w, rows in enumerate(group.windows(matrix([x], width)[0], own, label, same, low, high, need, k)):
                    out += [(anchor, w, vec, score) for score, vec in rows]
            return pa.table([pa.array(c, type=f.type) for c, f in zip(zip(*out) if out else [[]] * 4, HIT)], schema=HIT)

        def visit(asked: DataFrame, lead: bool) -> DataFrame:
            routed = stored(asked.mapInArrow(route(lead), ROUTE_DDL), "routed")
            blocks = routed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("blocks")).join(subs, "part")
            blocks = F.broadcast(blocks)  # a row a part, PARTS at most
            left = (routed.join(blocks, "part").withColumn("blk", F.pmod(F.xxhash64("anchor"), F.col("blocks")).cast("int"))
                    .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).drop("blocks", "subs"))
            right = index.join(blocks.drop("subs"), "part").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
            key = ["part", "sub", "blk"]
            return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "anchor long, k int, vec_id long, score long")

        first = stored(visit(asked, True), "lead-hits")
        rank = F.row_number().over(Window.partitionBy("anchor", "k").orderBy(F.desc("score"), "vec_id"))
        reached = first.withColumn("rank", rank).where(F.col("rank") == k).groupBy("anchor").agg(
            F.map_from_entries(F.collect_list(F.struct("k", F.col("score").cast("double")))).alias("reached"))  # a window each
        raised = asked.join(reached, "anchor", "left").withColumn("need", F.expr(
            "transform(need, (n, w) -> greatest(n, coalesce(try_element_at(reached, w), n)))")).drop("reached")
        hits = first.union(visit(raised, False))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    asked = stored(anchors.select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "x"), "anchors")
    any_score = [F.array(F.lit(v).cast("double")).alias(n) for n, v in (("low", "-Infinity"), ("high", "Infinity"), ("need", "-Infinity"))]
    near = stored(look(asked.select("*", *any_score), True, positives).select("anchor", "rank", "vec_id", "score"), "positives")
    windows = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("ps"))  # ``positives`` at most
    bound = "transform(ps, p -> cast({}(cast(p.score AS decimal(38, 0)) * {} / 100) AS double))"  # scores are whole numbers
    windows = (asked.join(windows, "anchor").withColumn("low", F.expr(bound.format("ceil", least)))
               .withColumn("high", F.expr(bound.format("floor", most))))
    windows = stored(windows.withColumn("need", F.col("low")), "windows")
    far = look(windows.select("anchor", "vec_id", "label", "x", "low", "high", "need"), False, negatives)
    told = windows.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("ps").alias("k", "p"))
    return (far.join(told, ["anchor", "k"])
            .select("anchor_id", F.col("p.vec_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                    F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score")))


@query("op11_hard_negatives", """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score
  FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""")
def op11(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    moved = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    vectors = labelled_vectors(moved)
    return hard_negatives(vectors, vectors.where("vec_id % 100 = 0"))
