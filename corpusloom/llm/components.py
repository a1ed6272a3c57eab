"""Connected components of an undirected graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._common import Workspace


def connected_components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node that each node reaches.

    Each round hangs every node on its smallest neighbour, then contracts the graph to what the
    nodes hang on, until no edge is left; the graph shrinks by half or more a round. All state
    stays in tables; minima are combined before the shuffle, so a hub costs no more than others.
    An empty edge table gives an empty result; loops and repeated edges change nothing.
    """
    a, b = F.col("a"), F.col("b")
    both = edges.where(a != b).select(a.alias("x"), b.alias("y")).union(edges.where(a != b).select(b.alias("x"), a.alias("y")))
    current = work.save(both.distinct())
    labels, rounds = None, 0
    while not current.isEmpty():
        hung = current.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("up"))
        above = hung.select(F.col("x").alias("up"), F.col("up").alias("top"))
        parent = work.save(hung.join(above, "up").select("x", F.col("top").alias("up")))  # one jump towards the root
        if labels is None:
            labels = parent.select(F.col("x").alias("node"), F.col("up").alias("component"))
        else:
            labels = labels.join(parent, labels.component == parent.x, "left").select("node", F.coalesce("up", "component").alias("component"))
        rounds += 1
        if rounds % 4 == 0:
            labels = work.save(labels)
        left = parent.select("x", F.col("up").alias("x2"))
        right = parent.select(F.col("x").alias("y"), F.col("up").alias("y2"))
        contracted = current.join(left, "x").join(right, "y").where("x2 <> y2").select(F.col("x2").alias("x"), F.col("y2").alias("y")).distinct()
        contracted = work.save(contracted)
        work.drop(current)
        current = contracted
    work.drop(current)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return work.save(labels)
