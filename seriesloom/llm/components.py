"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node u ties its larger (``large``) or its smaller-or-own neighbours to the least node it knows.
    A node's least neighbour is a partial aggregate and joins as one row, so a hub's links may be split."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v") if large else edges.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        tied = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select("v", "m").union(least.select(F.col("u"), F.col("m"))).toDF("a", "b")
    return tied.where("a <> b").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) for every node of ``links`` (``a``, ``b`` long).

    Each round stores its links, which are at most as many as at the start, in the shared folder. The
    rounds end when every link runs from a node to the least of its component; their number grows with
    the logarithm of the longest chain. Self-links and repeated links do no harm; no links, no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    while True:
        new = stored(_star(_star(edges, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False), "links")
        before, after = (x.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first() for x in (edges, new))
        edges = new
        if before == after:
            return edges.toDF("node", "component")
