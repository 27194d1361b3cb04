"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelab.llm.rows import written


def _least(links: DataFrame) -> DataFrame:
    """Written, so that the join with it reads two plain shuffles and a busy node is split."""
    return written(links.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` -> ``(node, component)``, component being the least node reached.

    Each round hangs the larger neighbours of every node on its least neighbour, then the
    smaller ones, until all components are stars; rounds grow with the logarithm of the
    number of nodes. A node's neighbours are never gathered: their minimum is combined on
    the map side and joined back, so a node with many links is an ordinary skewed join.
    Every round is a written table. Nodes without links are not returned; rows with a
    null end and links of a node with itself are ignored.
    """
    ends = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    known = F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))
    edges = written(links.where(known).select(*ends).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sides = both.join(_least(both).select("u", F.least("m", "u").alias("m")), "u")
        large = sides.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        up = large.join(_least(large), "u")
        small = up.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(up.select("u", F.col("m").alias("v"))).distinct(), "links")
        ends_of = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("up"))
        )
        seen = ends_of.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        open_nodes = (F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("low") == 0))
        if not seen.where(open_nodes).limit(1).count():
            break
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)
