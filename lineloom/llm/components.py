"""Connected components by alternating large and small stars.

Kiveris and others, "Connected Components in MapReduce and Beyond" (2014).  The
edges stay distributed; each round is written to the shared folder, and the driver
learns only how many nodes are not yet in a star.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


def _torn(edges: DataFrame) -> int:
    """How many nodes have two lesser neighbours, or lesser and greater ones; none if the edges are stars about their least nodes."""
    ends = edges.select(F.col("hi").alias("node"), F.lit(1).alias("up")).union(edges.select("lo", F.lit(0)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return ends.where("up > 1 or (up > 0 and n > up)").count()


def components(edges: DataFrame, written: bool = False) -> DataFrame:
    """(node, root) for every node of an edge, from edges (a, b) of any sortable type.

    The root is the least node of the component.  Loops and repeated edges do no harm;
    no edges give no rows.  ``written``: the edges are those of written tables, so that
    they need not be written before the first round.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    if not written:
        now = stash(now.distinct(), "edges")
    while _torn(now):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        with_least = large.join(least, "hi")
        small = least.select("hi", F.col("m").alias("lo")).union(with_least.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        old, now = now, stash(small.distinct(), "edges")
        discard(old)
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)
