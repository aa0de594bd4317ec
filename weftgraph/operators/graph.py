"""Undirected simple graphs as adjacency frames: measures, walks and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import checkpointed
from . import walks


def adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node, nbr[, w]) in both directions, parallel edges and self-loops dropped."""
    e = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *([F.col(weight).alias("w")] if weight else []))
    e = e.groupBy("u", "v").agg(F.max("w").alias("w")) if weight else e.distinct()
    extra = ["w"] if weight else []
    return e.select(F.col("u").alias("node"), F.col("v").alias("nbr"), *extra).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("nbr"), *extra))


def degrees(adj: DataFrame) -> DataFrame:
    return adj.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))


def shared_neighbours(pairs: DataFrame, adj: DataFrame) -> DataFrame:
    """(u, v, z) for every common neighbour z of each pair: two equi-joins, no product of nodes."""
    left = pairs.select("u", "v").join(adj.select(F.col("node").alias("u"), F.col("nbr").alias("z")), "u")
    return left.join(adj.select(F.col("node").alias("v"), F.col("nbr").alias("z")), ["v", "z"]).select("u", "v", "z")


def clustering(adj: DataFrame) -> DataFrame:
    """(node, triangles, coefficient); 0 for degrees below 2. Wedges start at the end of smaller degree."""
    deg = degrees(adj)
    ranked = adj.join(deg.select("node", F.col("deg").alias("dn")), "node").join(deg.select(F.col("node").alias("nbr"), F.col("deg").alias("db")), "nbr")
    up = ranked.filter("dn < db OR (dn = db AND node < nbr)").select("node", "nbr")
    wedge = up.alias("a").join(up.alias("b"), F.col("a.node") == F.col("b.node")).filter("a.nbr < b.nbr").select(F.col("a.node").alias("x"), F.col("a.nbr").alias("y"), F.col("b.nbr").alias("z"))
    closed = wedge.join(adj.select(F.col("node").alias("y"), F.col("nbr").alias("z")), ["y", "z"])
    corner = closed.select(F.explode(F.array("x", "y", "z")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("t"))
    d = F.col("deg")
    t = F.coalesce("t", F.lit(0))
    return deg.join(corner, "node", "left").select("node", t.cast("long").alias("triangles"), F.when(d > 1, 2.0 * t / (d * (d - 1))).otherwise(0.0).alias("coefficient"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 1, cap: int = 50) -> DataFrame:
    """(seed_set, node, hop) within ``hops`` of each seed set (seed_set, node); seeds excluded, nearest hop.

    Nodes whose degree, parallel edges counted, exceeds ``cap`` are reached but not walked through.
    """
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("nbr")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("nbr")))
    open_ = both.join(degrees(both).filter(F.col("deg") <= cap).select("node"), "node", "left_semi").distinct()
    seen = seeds.select("seed_set", "node").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(open_, "node").select("seed_set", F.col("nbr").alias("node")).distinct()
        frontier = step.join(seen, ["seed_set", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.filter("hop > 0")


def ancestors(is_a: DataFrame, limit: int = 6) -> DataFrame:
    """(child, ancestor, step) closure of (child, parent), nearest step, at most ``limit`` steps; cycles end."""
    reach = is_a.select("child", F.col("parent").alias("ancestor")).distinct().withColumn("step", F.lit(1))
    frontier = reach
    for step in range(2, limit + 1):
        up = frontier.join(is_a.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")), "ancestor")
        up = up.filter("next <> child").select("child", F.col("next").alias("ancestor")).distinct()
        frontier = checkpointed(up.join(reach, ["child", "ancestor"], "left_anti").withColumn("step", F.lit(step)))
        if frontier.isEmpty():
            break
        reach = reach.unionByName(frontier)
    return reach


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b), the root being the smallest node reachable.

    Large-star and small-star steps alternate until a round changes nothing.
    """
    link = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last = None
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


def candidates(adj: DataFrame, type_pairs: DataFrame, node_type, known: DataFrame | None = None) -> DataFrame:
    """(u, v): unknown pairs of a wanted type pair that a walk u - a - b - v joins, b other than u; without ``known``, linked pairs are known."""
    wanted = [(a, b) for a, b in map(tuple, type_pairs.select("t1", "t2").distinct().collect()) if a is not None and b is not None and a <= b]
    return walks.candidates(adj, wanted + [(b, a) for a, b in wanted], node_type, known)


def scored_candidates(adj: DataFrame, first: str, last: str, node_type, known: DataFrame | None = None) -> DataFrame:
    """(u, v, score): unknown pairs of types ``first`` and ``last`` that a walk u - a - b - v joins, b other than u, with the sum of 1 / sqrt(deg a * deg b) over its walks."""
    return walks.candidates(adj, [(first, last)], node_type, known, scored=True)


def non_edges_by_adamic_adar(adj: DataFrame, threshold: float = 0.7, top: int = 100) -> DataFrame:
    """(u, v, score, n_shared): unlinked pairs with shared neighbours, scores divided by the largest."""
    weight = degrees(adj).select(F.col("node").alias("z"), F.when(F.col("deg") > 1, 1 / F.log("deg")).otherwise(1.0).alias("w"))
    side = adj.select(F.col("nbr").alias("z"), F.col("node").alias("u"))
    wedge = side.join(side.select("z", F.col("u").alias("v")), "z").filter("u < v").join(weight, "z")
    pairs = wedge.groupBy("u", "v").agg(F.sum("w").alias("raw"), F.count(F.lit(1)).alias("n_shared"))
    open_ = pairs.join(adj.select(F.col("node").alias("u"), F.col("nbr").alias("v")), ["u", "v"], "left_anti")
    most = open_.agg(F.max("raw").alias("most"))
    scored = open_.join(F.broadcast(most)).withColumn("score", F.round(F.col("raw") / F.col("most"), 9))
    return scored.filter(F.col("score") >= threshold).orderBy(F.desc("score"), "u", "v").limit(top).select("u", "v", "score", "n_shared")


def statistics(edges: DataFrame, predicate: str, node_type) -> DataFrame:
    """Edge counts by type pair and predicate, with every subtotal: (type_pair, predicate, edges)."""
    typed = edges.withColumn("type_pair", F.concat_ws("-", F.least(node_type("u"), node_type("v")), F.greatest(node_type("u"), node_type("v"))))
    cube = typed.cube("type_pair", F.col(predicate).alias("predicate")).agg(F.count(F.lit(1)).alias("edges"))
    return cube.select(F.coalesce("type_pair", F.lit("*")).alias("type_pair"), F.coalesce("predicate", F.lit("*")).alias("predicate"), "edges")


def numbered(df: DataFrame, group: str, key: str, parts: int = 64) -> DataFrame:
    """``df`` with index 0, 1, ... within each group, by (part of a hash of key, key); no group is sorted in one task."""
    part = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 4), 16, 10).cast("int") % parts
    x = df.withColumn("_part", part)
    sizes = x.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    sizes = sizes.select(group, "_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("pool_size"))
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key)) - 1
    return x.withColumn("_rank", rank).join(sizes, [group, "_part"]).withColumn("index", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")
