"""Link predictors: each scores a whole frame of pairs at once.

A predictor takes pairs (u, v) and an adjacency frame and returns (u, v, score) for every
pair; pairs of unknown nodes score 0. Custom predictors follow the same protocol.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import walks
from .graph import degrees, shared_neighbours


class Predictor(Protocol):
    def __call__(self, pairs: DataFrame, adj: DataFrame) -> DataFrame: ...


def _filled(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    return pairs.select("u", "v").join(scores, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))


def common_neighbours(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    return _filled(pairs, shared_neighbours(pairs, adj).groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("score")))


def adamic_adar(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """Sum of 1 / ln(degree) of the shared neighbours; one of degree 1 counts 1."""
    deg = degrees(adj).select(F.col("node").alias("z"), F.when(F.col("deg") > 1, 1 / F.log("deg")).otherwise(1.0).alias("w"))
    return _filled(pairs, shared_neighbours(pairs, adj).join(deg, "z").groupBy("u", "v").agg(F.sum("w").alias("score")))


def _with_degrees(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    deg = degrees(adj)
    du, dv = deg.select(F.col("node").alias("u"), F.col("deg").alias("du")), deg.select(F.col("node").alias("v"), F.col("deg").alias("dv"))
    return pairs.select("u", "v").join(du, "u", "left").join(dv, "v", "left").fillna(0, ["du", "dv"])


def jaccard(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    both = shared_neighbours(pairs, adj).groupBy("u", "v").agg(F.count(F.lit(1)).alias("i"))
    x = _with_degrees(pairs, adj).join(both, ["u", "v"], "left").fillna(0, ["i"])
    union = F.col("du") + F.col("dv") - F.col("i")
    return x.select("u", "v", F.when(union > 0, F.col("i") / union).otherwise(0.0).alias("score"))


def preferential_attachment(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    return _with_degrees(pairs, adj).select("u", "v", (F.col("du") * F.col("dv")).cast("double").alias("score"))


def l3_paths(pairs: DataFrame, adj: DataFrame, weighted: bool = False) -> DataFrame:
    """Sum over walks u - a - b - v, b other than u, of 1 / sqrt(deg a * deg b), times the edge weights if wanted.

    The first two steps are summed by (u, b) once for each distinct u, however many pairs
    share it, and meet the last step of each pair.
    """
    deg = degrees(adj)
    w = F.col("w") if weighted else F.lit(1.0)
    ends = adj.select("node", "nbr", w.alias("w"))
    share = deg.select(F.col("node").alias("nbr"), (1 / F.sqrt("deg")).alias("s"))
    near = ends.join(share, "nbr").withColumn("f", F.col("w") * F.col("s"))
    left = pairs.select("u").distinct().join(near.select(F.col("node").alias("u"), F.col("nbr").alias("a"), F.col("f").alias("fu")), "u")
    middle = left.join(ends.select(F.col("node").alias("a"), F.col("nbr").alias("b"), F.col("w").alias("wm")), "a").filter("b <> u")
    two = middle.groupBy("u", "b").agg(F.sum(F.col("fu") * F.col("wm")).alias("f2"))
    last = pairs.select("u", "v").join(near.select(F.col("node").alias("v"), F.col("nbr").alias("b"), F.col("f").alias("fv")), "v")
    return _filled(pairs, last.join(two, ["u", "b"]).groupBy("u", "v").agg(F.sum(F.col("f2") * F.col("fv")).alias("score")))


def neighbour_scores(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """(u, v, common_neighbours, adamic_adar, jaccard, preferential_attachment) from one search for shared neighbours."""
    deg = degrees(adj).select(F.col("node").alias("z"), F.when(F.col("deg") > 1, 1 / F.log("deg")).otherwise(1.0).alias("w"))
    shared = shared_neighbours(pairs, adj).join(deg, "z").groupBy("u", "v").agg(F.count(F.lit(1)).alias("i"), F.sum("w").alias("aa"))
    x = _with_degrees(pairs, adj).join(shared, ["u", "v"], "left").fillna(0, ["i", "aa"])
    union = F.col("du") + F.col("dv") - F.col("i")
    return x.select(
        "u", "v", F.col("i").cast("double").alias("common_neighbours"), F.col("aa").cast("double").alias("adamic_adar"),
        F.when(union > 0, F.col("i") / union).otherwise(0.0).alias("jaccard"), (F.col("du") * F.col("dv")).cast("double").alias("preferential_attachment"),
    )


def path_power(pairs: DataFrame, adj: DataFrame, k: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Entry (u, v) of the k-th power of the degree-normalised adjacency matrix, k >= 2; ``keep`` are columns of pairs to return."""
    if k < 2:
        raise ValueError("k must be at least 2")
    return walks.path_power(pairs, adj, k, keep)


def random_scores(pairs: DataFrame, adj: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """A uniform score in [0, 1) from a hash of seed and pair."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "u", "v")), 1, 8), 16, 10).cast("long")
    return pairs.select("u", "v", (h / F.lit(4294967296.0)).alias("score"))


PREDICTORS: dict[str, Predictor] = {
    "common_neighbours": common_neighbours,
    "adamic_adar": adamic_adar,
    "jaccard": jaccard,
    "preferential_attachment": preferential_attachment,
    "l3_paths": l3_paths,
    "random": random_scores,
}
