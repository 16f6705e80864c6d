"""Connected components of a large edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction: link each node's neighbours (the larger ones, or the smaller and
    itself) to the smallest node around it. Edges are (u, v) with u > v."""
    if larger:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
    else:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m"))
    least = both.groupBy("n").agg(F.min("m").alias("least")).withColumn("least", F.least("n", "least"))
    joined = both.join(least, "n")
    if larger:
        out = joined.where("m > n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.where("m <> least").select(F.col("m").alias("u"), F.col("least").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("least").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b of any order) -> ``(node, label)`` for every node with an edge to
    another node; the label is the smallest node of its component.

    Each round writes the edges in the shared folder; rounds end when nothing changes
    (about the logarithm of the longest path). No node's neighbours are gathered.
    """
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        now = written(_stars(_stars(now, True), False), "edges")
        # order-free fingerprint of the edge set; two aggregates in one pass
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further ``edges`` (a, b): components of the labels that the edges
    join, a graph of labels only. Nodes without a label are their own."""
    ends = edges
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
        ends = ends.join(own, side, "left").withColumn(f"l{side}", F.coalesce(f"l{side}", side))
    ends = written(ends, "ends")
    over = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("over"))
    new = ends.select(F.col("a").alias("node"), F.col("la").alias("label")).unionByName(ends.select(F.col("b").alias("node"), F.col("lb").alias("label"))).where("node = label")
    nodes = labels.unionByName(new).distinct()
    return written(nodes.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label")), "labels")
