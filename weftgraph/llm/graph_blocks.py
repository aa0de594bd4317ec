"""Connected components in DataFrame operations, for groups too large to gather."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b), root being the smallest node reachable.

    Alternating large-star and small-star steps; each is a pre-aggregated minimum and
    an equi-join, so a node with very many neighbours is split like any skewed join.
    Stops when a round changes nothing; edges between a node and itself don't count.
    """
    link = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    link, last = checkpointed(link), None
    while True:
        both = link.unionByName(link.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        link = checkpointed(small.filter("u <> v").distinct())
        now = link.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return link.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(link.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(n: int, a: np.ndarray, b: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest member of each of n members' component, given the links between members a and members b."""
    root = np.arange(n)
    if not link.any():
        return root
    far = np.iinfo(np.int64).max
    while True:
        low = root.copy()
        np.minimum.at(low, a, np.where(link, root[b][None, :], far).min(axis=1))
        np.minimum.at(low, b, np.where(link, root[a][:, None], far).min(axis=0))
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            return root
        root = low
