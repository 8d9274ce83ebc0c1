"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import columns, in_batches, load, stored, whole_groups
from seriesloom.llm.components import connected
from seriesloom.llm.registry import query

MARGIN = 1e-7  # angles (radians) nearer to a bound than this are settled by the pair's own cosine
BITS_SLACK = 5.0  # standard deviations of a sign count by which a pair may miss its expected one
PAIRS = 1 << 19  # pairs that are compared together

UNIT = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("x", pa.binary())])
SIGNED = pa.schema([("node", pa.int64()), ("w", pa.int64()), ("least", pa.int64()), ("x", pa.binary()), ("sig", pa.binary()),
                    ("keys", pa.list_(pa.int64()))])
PAIR = pa.schema([("p", pa.int64()), ("q", pa.int64())])
VERDICT = pa.schema([("p", pa.int64()), ("q", pa.int64()), ("sure", pa.bool_())])
COUNT = pa.schema([("node", pa.int64()), ("p", pa.int64()), ("q", pa.int64()), ("n", pa.int64())])


def tables_for(rows: int, cosine: float, miss: float) -> tuple[int, int]:
    """Signs a table and number of tables: a table deals ``rows`` vectors to about a sixteenth as many
    buckets, and a pair at the threshold shares no bucket in any table with probability ``miss`` at most."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))) - 4)
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def unit_vectors(df: DataFrame) -> DataFrame:
    """``row`` (a number of its own), ``vec_id``, ``x``: the vector scaled to length 1 as doubles; null where it is
    null, empty, zero or holds a null or non-finite component."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row, vec_id, v in zip(*columns(batch, "row", "vec_id", "embedding")):
                    x = None
                    if v and None not in v:
                        a = np.array(v, dtype=np.float64)
                        top = np.abs(a).max()
                        if np.isfinite(top) and top > 0:
                            a = a / top + 0.0  # so that no square over- or underflows; no negative zero
                            x = (a / np.sqrt((a * a).sum())).astype("<f8").tobytes()
                    yield row, vec_id, x
        yield from in_batches(rows(), UNIT)
    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return numbered.mapInArrow(run, "row long, vec_id long, x binary")


def matrix(rows: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    if rows and all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), "<f8").reshape(-1, width)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, :len(r) // 8] = np.frombuffer(r, "<f8")
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


def pairs_within(first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, of rows of the groups that start at ``first`` and hold ``size`` rows, some at a time."""
    later = np.concatenate([np.arange(s - 1, -1, -1) for s in size]) if len(size) else np.empty(0, np.int64)
    row = np.concatenate([np.arange(f, f + s) for f, s in zip(first, size)]) if len(size) else later
    total = np.cumsum(later)
    at = 0
    while at < len(row):
        end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        n = later[at:end]
        i = np.repeat(row[at:end], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        at = end


def near_vectors(df: DataFrame, cosine: float = 0.9, miss: float = 1e-3, seed: int = 12, block: int = 1000) -> DataFrame:
    """One row per row of ``df`` (``vec_id``, ``embedding``): ``vec_id, n_links, component_id``.

    Two vectors are linked if their cosine in double precision is ``cosine`` or more. ``n_links`` counts the
    other rows linked with a row, ``component_id`` is the smallest vec_id reachable over links.

    1. Equal vectors become one node with a weight. A node gets one key a table, made of the signs of its
       products with random planes; a pair at the threshold is overlooked with probability ``miss``
       (:func:`tables_for`), a closer pair with less.
    2. Nodes gather in balls: in each bucket the node with the least hash is the pivot, a node chooses the pivot it
       meets most often, and joins it if their angle is at most half the threshold's. Any two nodes
       of a ball are then linked, so a large group of copies is counted without a look at its pairs.
    3. Balls that share a bucket are candidates. A bucket is cut into blocks of ``block`` balls and every two
       blocks meet in one bounded group, where the whole signatures discard what cannot be near enough.
    4. The exact angle of two centres and the radii settle most pairs of balls; in the others each member of
       one is held against each of the other, again in bounded blocks. Links are counted, never listed.
    5. Components of linked balls come from :func:`components.connected`.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do rows
    without a partner: ``n_links`` 0 and their own vec_id. Rows with the same vec_id are vectors of their own; rows
    without one are linked like others and lend no id (null if no member has one). A vector of fewer
    components is filled up with zeros. Other columns are not read; an empty table gives an empty result.
    """
    theta = math.acos(cosine)
    rows = stored(unit_vectors(df), "unit-vectors")
    distinct = (rows.where("x is not null").groupBy("x")
                .agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least")))
    distinct = stored(distinct.select("node", "w", "least", "x"), "vectors")
    facts = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("x")).alias("bytes")).first()
    width = max((facts.bytes or 0) // 8, 1)
    bits, tables = tables_for(facts.n, cosine, miss)
    total = bits * tables

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((width, total))
        powers = 1 << np.arange(bits, dtype=np.int64)
        first = np.arange(tables, dtype=np.int64) << bits
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                positive = matrix(part.column("x").to_pylist(), width) @ planes > 0
                keys = (positive.reshape(-1, tables, bits) * powers).sum(axis=2) + first
                sig = np.packbits(positive, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ("node", "w", "least", "x")), pa.array([s.tobytes() for s in sig], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))], schema=SIGNED)

    nodes = stored(distinct.mapInArrow(sign, "node long, w long, least long, x binary, sig binary, keys array<long>"), "signs")
    places = nodes.select("node", F.explode("keys").alias("bucket"))
    pivots = (places.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("least"))
              .where("m > 1").select("bucket", F.col("least.node").alias("pivot"), F.col("least.h").alias("h")))
    met = (places.join(pivots, "bucket").where("node <> pivot").groupBy("node", "pivot")
           .agg(F.count(F.lit(1)).alias("c"), F.first("h").alias("h")))
    choice = met.groupBy("node").agg(F.max_by("pivot", F.struct("c", "h", "pivot")).alias("pivot"))
    centre = nodes.select(F.col("node").alias("pivot"), F.col("x").alias("cx"))
    offered = nodes.select("node", "w", "x", "keys").join(choice, "node", "left").join(centre, "pivot", "left")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            pivot = batch.column("pivot").fill_null(-1).to_numpy()
            x, cx = columns(batch, "x", "cx")
            angle = angles(cosines(matrix(x, width), matrix([c or b"" for c in cx], width)))
            inside = (pivot >= 0) & (angle <= theta / 2 - MARGIN)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("w"), batch.column("x"), batch.column("keys"),
                 pa.array(np.where(inside, pivot, node)), pa.array(np.where(inside, angle, 0.0))], names=["node", "w", "x", "keys", "ball", "angle"])

    members = stored(offered.mapInArrow(gather, "node long, w long, x binary, keys array<long>, ball long, angle double"), "members")
    balls = (members.groupBy("ball").agg(F.sum("w").alias("weight"), F.max("angle").alias("radius"), F.count(F.lit(1)).alias("size"))
             .join(nodes.select(F.col("node").alias("ball"), "x", "sig"), "ball"))
    balls = stored(balls, "balls")

    present = members.select("ball", F.explode("keys").alias("bucket")).distinct()
    shared = present.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(
        "bucket", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    dealt = (present.join(shared, "bucket").join(balls.select("ball", "radius", "sig"), "ball")
             .withColumn("at", F.pmod(F.xxhash64("ball"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("bucket", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "ball", "radius", "sig"))
    place = ["bucket", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, *place):
            key = np.stack([table.column(n).to_numpy() for n in place])
            first = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            size = np.diff(np.concatenate([first, [key.shape[1]]]))
            ball, at, radius = (table.column(n).to_numpy() for n in ("ball", "at", "radius"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(ball), -1)
            words = np.zeros((len(ball), -(-sig.shape[1] // 8) * 8), np.uint8)
            words[:, :sig.shape[1]] = sig
            words = words.view(np.uint64)
            one_block = key[1] == key[2]
            for i, j in pairs_within(first, size):
                cross = one_block[i] | (at[i] != at[j])
                i, j = i[cross], j[cross]
                differ = np.zeros(len(i), np.int64)
                for k in range(words.shape[1]):
                    differ += np.bitwise_count(words[i, k] ^ words[j, k])
                share = np.minimum((theta + radius[i] + radius[j]) / math.pi, 1.0)
                may = differ <= total * share + BITS_SLACK * np.sqrt(total * share * (1 - share)) + 1
                a, b = ball[i[may]], ball[j[may]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIR)

    near = dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(compare, "p long, q long").distinct()
    sides = [balls.select(F.col("ball").alias(s), F.col("x").alias(f"{s}x"), F.col("radius").alias(f"{s}r")) for s in ("p", "q")]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = cosines(*(matrix(batch.column(n).to_pylist(), width) for n in ("px", "qx")))
            angle = angles(cos)
            wide = batch.column("pr").to_numpy() + batch.column("qr").to_numpy()
            sure = np.where(wide == 0, cos >= cosine, angle + wide <= theta - MARGIN)
            open_ = ~sure & (wide > 0) & (angle - wide <= theta + MARGIN)
            keep = np.flatnonzero(sure | open_)
            yield pa.RecordBatch.from_arrays([batch.column("p").take(pa.array(keep)), batch.column("q").take(pa.array(keep)), pa.array(sure[keep])], schema=VERDICT)

    settled = stored(near.join(sides[0], "p").join(sides[1], "q").select("p", "q", "px", "qx", "pr", "qr")
                     .mapInArrow(settle, "p long, q long, sure boolean"), "settled")
    sure = settled.where("sure").select("p", "q")
    mixed = settled.where("not sure").select("p", "q")
    sizes = [balls.select(F.col("ball").alias(s), F.ceil(F.col("size") / block).cast("int").alias(f"{s}n")) for s in ("p", "q")]
    cut = mixed.join(sizes[0], "p").join(sizes[1], "q")
    held = members.select("ball", "node", "w", "x")

    def side(own: str, other: str, i: str, j: str) -> DataFrame:
        slot = F.pmod(F.xxhash64("node"), F.col(f"{own}n")).cast("int").alias(i)
        return (cut.join(held, cut[own] == held.ball)
                .select("p", "q", slot, F.explode(F.sequence(F.lit(0), F.col(f"{other}n") - 1)).alias(j), "node", "w", "x", F.lit(own == "p").alias("left"))
                .select("p", "q", "i", "j", "left", "node", "w", "x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for table in whole_groups(batches, "p", "q", "i", "j"):
                group: dict[tuple, tuple[list, list]] = {}
                for p, q, i, j, left, node, w, x in zip(*columns(table, "p", "q", "i", "j", "left", "node", "w", "x")):
                    group.setdefault((p, q, i, j), ([], []))[0 if left else 1].append((node, w, x))
                for (p, q, _, _), (a, b) in group.items():
                    if not a or not b:
                        continue
                    linked = matrix([r[2] for r in a], width) @ matrix([r[2] for r in b], width).T >= cosine
                    for own, weight in ((a, linked @ np.array([r[1] for r in b])), (b, np.array([r[1] for r in a]) @ linked)):
                        yield from ((r[0], p, q, int(n)) for r, n in zip(own, weight) if n)
        yield from in_batches(found(), COUNT)

    group = ["p", "q", "i", "j"]
    counted = stored(side("p", "q", "i", "j").union(side("q", "p", "j", "i").select(*group, "left", "node", "w", "x")).repartition(*group)
                     .sortWithinPartitions(*group).mapInArrow(count, "node long, p long, q long, n long"), "counted")
    links = sure.union(counted.select("p", "q").distinct())
    component = connected(links.toDF("a", "b")).toDF("ball", "component")
    weight = balls.select("ball", "weight")
    around = (sure.union(sure.select("q", "p")).toDF("ball", "other").join(weight.toDF("other", "weight"), "other")
              .groupBy("ball").agg(F.sum("weight").alias("around")))
    own = counted.groupBy("node").agg(F.sum("n").alias("own"))
    of_ball = weight.join(around, "ball", "left").join(component, "ball", "left").select(
        "ball", (F.col("weight") - 1 + F.coalesce("around", F.lit(0))).alias("n"), F.coalesce("component", "ball").alias("component"))
    of_node = (members.select("node", "ball").join(of_ball, "ball").join(own, "node", "left")
               .select("node", "component", (F.col("n") + F.coalesce("own", F.lit(0))).alias("n_links")))
    of_node = stored(of_node.join(nodes.select("node", "least"), "node"), "node-links")
    ids = of_node.groupBy("component").agg(F.min("least").alias("component_id"))
    by_vector = (of_node.join(ids, "component").join(nodes.select("node", "x"), "node")
                 .select("x", "n_links", "component_id", F.lit(True).alias("found")))
    return rows.join(by_vector, "x", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))


@query("op12_vector_duplicates", """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id LEFT JOIN n ON n.x = e.vec_id
""")
def op12(spark, sf_dir):
    return (near_vectors(load(spark, sf_dir, "embeddings"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
