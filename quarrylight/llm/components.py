"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import checkpoint


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node reachable from each of n nodes."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            to = label[label]
            if (to == label).all():
                break
            label = to
        live = label[u] != label[v]
        u, v = u[live], v[live]
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge table (a, b); a component is named by its least node.

    Each round moves all edges closer to stars around the least node, in
    O(log) rounds, whatever the degree of a node; a round is cut off by a
    checkpoint in the shared folder.  Edges with a null end are ignored, loops
    make components of one.
    """
    at = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    at = checkpoint(at.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        by = Window.partitionBy("a")
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.withColumn("m", F.least("a", F.min("b").over(by))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(at.where("a = b")).distinct()
        small = large.withColumn("m", F.min("b").over(by))
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a >= b").distinct()
        at = checkpoint(small)
        now = at.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    return at.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
