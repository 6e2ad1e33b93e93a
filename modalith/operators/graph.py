"""Connected components of a bipartite graph of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modalith.sources.session import checkpoint


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of an undirected graph (u, v): least node by propagation with shortcuts.

    Each round takes the least label among neighbours and then the label of that label, so long chains settle in
    logarithmically many rounds. The lineage is cut with checkpoint() in the session's shared folder."""
    both = checkpoint(edges.select("u", "v").union(edges.select("v", "u")).toDF("u", "v").distinct())
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(max_rounds):
        near = both.join(labels.toDF("v", "l"), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        jump = checkpoint(step.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", "was", F.least("label", "next").alias("label")))
        labels = jump.select("node", "label")
        if jump.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")


def request_clusters(pairs: DataFrame, left: str, right: str, fallback: str) -> DataFrame:
    """pairs with the cluster of their requests: requests that a pair joins are one cluster. Where any request of
    the table is blank, all pairs are clustered by the column `fallback` instead."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    if not pairs.where(blank(left) | blank(right)).isEmpty():
        return pairs.withColumn("cluster", F.col(fallback))
    found = components(pairs.select(F.col(left).alias("u"), F.col(right).alias("v")))
    return pairs.join(found.select(F.col("node").alias(left), F.col("component").alias("cluster")), left)
