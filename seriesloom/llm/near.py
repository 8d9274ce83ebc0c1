"""Near-duplicate documents by min-max hashing and exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import U64, columns, in_batches, load, mix64, release, shingles, signed, stored, texts, word_hashes
from seriesloom.llm.components import connected
from seriesloom.llm.registry import query

SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
                    ("bands", pa.list_(pa.int64()))])
MEMBER = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("node", pa.int64()), ("tokens", pa.binary())])
LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def bands_for(percent: int, miss: float = 1e-6) -> int:
    """Bands of two permutations (two minima, two maxima) after which a pair at the threshold is
    overlooked with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** 4))


def min_max_bands(tokens: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One key a band: each permutation of the hash values is evaluated once and gives both its minimum
    and its maximum; a band joins those of two permutations."""
    low = np.full(len(factors), ~U64(0), dtype=np.uint64)
    high = np.zeros(len(factors), dtype=np.uint64)
    for at in range(0, len(tokens), 4096):
        values = tokens[None, at:at + 4096] * factors[:, None] + offsets[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    key = np.arange(len(factors) // 2, dtype=np.uint64)
    for part in (low[::2], high[::2], low[1::2], high[1::2]):
        key = mix64(key * U64(0xC2B2AE3D27D4EB4F) + part)
    return key


def links_among(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the smallest index it is linked with, directly or through others, by
    100 * intersection >= percent * union on whole sets. Common tokens are counted by matrix products,
    rare ones by their few pairs."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    first = np.concatenate([[0], np.cumsum(df)[:-1]])
    both = np.zeros((m, m), dtype=np.float32)
    for d in range(2, 9):
        held = owner[first[df == d][:, None] + np.arange(d)]
        for x in range(d):
            for y in range(x):
                both += np.bincount(held[:, x] * m + held[:, y], minlength=m * m).reshape(m, m) if len(held) else 0
    both += both.T
    common = np.flatnonzero(df > 8)
    for at in range(0, len(common), 2048):
        ids = common[at:at + 2048]
        dense = np.zeros((m, len(ids)), dtype=np.float32)
        column = np.full(len(df), -1)
        column[ids] = np.arange(len(ids))
        here = column[token] >= 0
        dense[owner[here], column[token[here]]] = 1
        both += dense @ dense.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        new = np.where(linked, label[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def near_duplicates(df: DataFrame, percent: int = 80, words: int = 5, seed: int = 20, group_tokens: int = 500_000,
                    group_sets: int = 1000) -> DataFrame:
    """One row per row of ``df`` (``doc_id``, ``text``): ``doc_id, n_shingles, component_id``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of ``words``-word
    shingles; ``component_id`` is the smallest doc_id reachable over links.

    1. Every document gets its min-max band keys and a 128-bit digest of its set. Documents of one set
       become one node (the smallest doc_id) by a partial aggregate, however many there are.
    2. Nodes that share a band key are candidates. Buckets with the same members in several bands are
       looked at once. A bucket is cut into blocks of ``group_sets`` sets or ``group_tokens`` shingles,
       and every two blocks meet in one group, so a group's size is bounded and no pair is left out.
    3. A group confirms its links on full sets and emits a spanning forest, never all pairs. A shingle is told by 64 bits
       of its hash: two different ones among a pair's 10,000 agree with a probability below 10^-11.
    4. Components of the forest are worked out by :func:`components.connected`.

    Texts that are null or have no words have n_shingles 0 and are linked with nothing. Rows without
    doc_id lend no id to a component (null if no member has one). Rows with the same doc_id are one
    node. Empty tables give empty results; other columns are not read.
    """
    bands = bands_for(percent)
    rng = np.random.default_rng(seed)
    factors = rng.integers(0, 2**63, 2 * bands, dtype=np.uint64) * U64(2) + U64(1)
    offsets = rng.integers(0, 2**63, 2 * bands, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("near")

        def rows():
            for batch in batches:
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                    s = shingles(word_hashes(text or b""), words)
                    if not len(s):
                        yield doc, 0, 0, 0, []
                        continue
                    digest = signed(np.array([mix64(s).sum(), mix64(s + U64(1)).sum() ^ U64(len(s))]))
                    yield doc, len(s), int(digest[0]), int(digest[1]), signed(min_max_bands(s, factors, offsets))
        yield from in_batches(rows(), SKETCH, 500)
        release()

    docs = df.select(F.col("doc_id").cast("long"), "text")
    sketches = stored(docs.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "sketch")
    # One row a set. Small: no text and no shingles.
    nodes = stored(sketches.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b")
                   .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    # Two hash sums stand for a bucket's members: of buckets with equal ones, the smallest key is kept.
    buckets = (members.groupBy("bucket")
               .agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"), F.bit_xor(F.xxhash64("node")).alias("x"),
                    F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
               .where("m > 1").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"), F.first("tokens").alias("tokens"))
               .select("bucket", F.ceil(F.greatest(F.col("m") / group_sets, F.col("tokens") / group_tokens)).cast("int").alias("blocks")))
    places = (members.join(buckets, "bucket")
              .withColumn("at", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
              .groupBy("node").agg(F.collect_list(F.struct("bucket", "blocks", "at")).alias("places")))  # a row a band at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for node, where, text in zip(*columns(batch, "node", "places"), texts(batch.column("text"))):
                    s = shingles(word_hashes(text or b""), words)
                    tokens = s.tobytes()
                    for p in where:
                        for other in range(p["blocks"]):
                            if other != p["at"] or p["blocks"] == 1:
                                yield p["bucket"], min(p["at"], other), max(p["at"], other), node, tokens
        yield from in_batches(rows(), MEMBER, 500)
        release()

    def confirm(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        order = np.argsort(node)
        raw = group.column("tokens").to_pylist()
        label = links_among([np.frombuffer(raw[k], np.uint64) for k in order], percent)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[order][moved], "b": node[order][label[moved]]}, schema=LINK)

    dealt = (docs.join(places, docs.doc_id == places.node).select("node", "places", "text")
             .mapInArrow(deal, "bucket long, i int, j int, node long, tokens binary"))
    forest = dealt.groupBy("bucket", "i", "j").applyInArrow(confirm, "a long, b long")
    component = connected(forest)
    of_set = (nodes.join(component, "node", "left")
              .select("set_a", "set_b", F.coalesce("component", "node").alias("component_id")))
    return (sketches.select("doc_id", "n_shingles", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("set_a", "set_b")])
            .join(of_set, ["set_a", "set_b"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


@query("op7_near_duplicates", """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(greatest(len(w) - 4, 1)), lambda i: md5(array_to_string(w[i + 1:i + 5], ' '))) END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n ON n.doc_id = x JOIN n AS k ON k.doc_id = y WHERE 100 * c >= 85 * (n.n + k.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, d.doc_id = min(r.y) AS kept
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""")
def op7(spark, sf_dir):
    return (near_duplicates(load(spark, sf_dir, "documents"), percent=85)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))
