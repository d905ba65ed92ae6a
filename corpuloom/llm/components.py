"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, label): every node of links (a, b bigint) and the smallest node it can reach.

    Each round takes the smallest label among a node's neighbours and itself, then that label's own
    label, so paths shrink by half.  Labels only sink, so it ends when their sum stays.  Nodes of very
    many links meet only partial minima and joins whose large side Spark can split.  An empty table
    gives no rows.
    """
    pairs = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(both.unionByName(both.select("a", F.col("a").alias("b"))).distinct())
    labels, before = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), None
    while True:
        at = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = cut(labels.join(at, "label", "left").select("node", F.least("label", "further").alias("label")))
        total = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        seen = labels.select(F.col("node").alias("b"), "label")
        labels = edges.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label"))


def hopped(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node within two links, for every node of links; cheap, and mostly the component."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")))
    seen = near.select(F.col("a").alias("b"), "label")
    return cut(both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("label")))
