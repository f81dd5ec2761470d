"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listloom.session import discard, stored_at


def _stars_only(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, or only edges from larger ones: then all is done."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1)).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge ``u - v``; a component is named by its least node.

    Alternates two star contractions (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): the number of rounds grows with the logarithm of the graph, not with its
    diameter, and a hub only ever contributes one minimum per map task plus one row per edge.
    Every round is written to the shared folder, and the round before it deleted; edges that are
    stars to begin with take no round at all.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v")
    current, path = stored_at(pairs.select("u", "v").distinct(), "components")
    while not _stars_only(current):
        # larger neighbours of every node move to the least node around it
        both = current.select("u", "v").union(current.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # smaller neighbours of every node, and the node itself, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before = path
        current, path = stored_at(small, "components")
        discard(spark, before)
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
