"""Temporal split of dated assertions, and the evidence known before the cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs: u and v are the smaller and the larger of columns a and b; self-pairs go."""
    return df.filter(F.col(a) != F.col(b)).withColumns({"u": F.least(a, b), "v": F.greatest(a, b)})


def first_years(assertions: DataFrame) -> DataFrame:
    """(u, v, first_year, undated) of each pair; first_year is null if no assertion has a year."""
    pairs = canonical(assertions, "subject", "object")
    return pairs.groupBy("u", "v").agg(F.min("year").alias("first_year"), F.max(F.col("year").isNull()).alias("undated"))


def temporal_split(assertions: DataFrame, backbone: DataFrame, cutoff: int) -> DataFrame:
    """(u, v, first_year, role) of every pair: train, backbone, known, cold or test.

    A pair first asserted before the cutoff trains. Backbone pairs and pairs with an undated
    assertion are structure. A later pair is known if it is structure, cold if an endpoint
    is in no training or backbone pair, else test. A training pair of the backbone is train.
    """
    dated = first_years(assertions)
    fixed = canonical(backbone.select(F.col("u").alias("_a"), F.col("v").alias("_b")), "_a", "_b").select("u", "v").unionByName(dated.filter("undated").select("u", "v")).distinct()
    pairs = dated.filter("first_year IS NOT NULL").select("u", "v", "first_year").join(fixed.withColumn("fixed", F.lit(True)), ["u", "v"], "full")
    old = (F.col("first_year") < cutoff) | F.col("fixed")
    known = pairs.filter(old)
    nodes = known.select(F.col("u").alias("n")).unionByName(known.select(F.col("v").alias("n"))).distinct()
    both = pairs.join(nodes.select(F.col("n").alias("u"), F.lit(True).alias("has_u")), "u", "left").join(nodes.select(F.col("n").alias("v"), F.lit(True).alias("has_v")), "v", "left")
    role = (
        F.when(F.col("first_year") < cutoff, "train")
        .when(F.col("first_year").isNull(), "backbone")
        .when(F.col("fixed"), "known")
        .when(F.col("has_u") & F.col("has_v"), "test")
        .otherwise("cold")
    )
    return both.select("u", "v", "first_year", role.alias("role"))


def evidence(assertions: DataFrame, cutoff: int) -> DataFrame:
    """(u, v, support, total_confidence, negated_count, dominant_predicate, weight) from years before the cutoff.

    The dominant predicate is the most frequent, then the first by name; the weight grows
    with the mean confidence and the log of the support, and falls with the negated share.
    """
    pairs = canonical(assertions, "subject", "object").filter(F.col("year") < cutoff)
    by_predicate = pairs.groupBy("u", "v", "predicate").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("c"), F.sum(F.col("negated").cast("int")).alias("g"))
    rank = F.struct((-F.col("n")).alias("n"), F.col("predicate"))
    out = by_predicate.groupBy("u", "v").agg(
        F.sum("n").cast("long").alias("support"),
        F.sum("c").alias("total_confidence"),
        F.sum("g").cast("long").alias("negated_count"),
        F.min_by("predicate", F.when(F.col("predicate").isNotNull(), rank)).alias("dominant_predicate"),
    )
    return out.withColumn("weight", edge_weight("support", "total_confidence", "negated_count"))


def edge_weight(support: str, total: str, negated: str) -> Column:
    n = F.col(support)
    full = F.col(total) / n * F.log1p(n) * (1 - 0.5 * F.col(negated) / n)
    return F.when(n > 0, F.greatest(F.lit(0.05), full)).otherwise(1.0)


def year_distribution(assertions: DataFrame) -> DataFrame:
    """(year, pairs, cumulative): distinct pairs by first year."""
    years = first_years(assertions).filter("first_year IS NOT NULL").groupBy(F.col("first_year").alias("year")).agg(F.count(F.lit(1)).alias("pairs"))
    return years.withColumn("cumulative", F.sum("pairs").over(Window.orderBy("year")))


def drop_leaked(edges: DataFrame, held_out: DataFrame) -> DataFrame:
    """(u, v, leaked) of every distinct canonical edge: leaked if it is held out, in either direction."""
    mine = canonical(edges.select(F.col("u").alias("_a"), F.col("v").alias("_b")), "_a", "_b").select("u", "v").distinct()
    test = canonical(held_out.select(F.col("u").alias("_a"), F.col("v").alias("_b")), "_a", "_b").select("u", "v").distinct().withColumn("hit", F.lit(True))
    return mine.join(test, ["u", "v"], "left").select("u", "v", F.coalesce("hit", F.lit(False)).alias("leaked"))


def validation_slice(train: DataFrame, share: float = 0.15) -> DataFrame:
    """(u, v, first_year, slice): the latest ``share`` of dated training pairs validates; undated ones fit.

    Whole years are counted first; ranks are given within the one year that is divided, in
    ranges of u, so that no year is sorted in one task.
    """
    years = train.filter("first_year IS NOT NULL").groupBy("first_year").agg(F.count(F.lit(1)).alias("n"))
    later = F.sum("n").over(Window.orderBy(F.desc("first_year"))) - F.col("n")
    years = years.select("first_year", "n", later.alias("later"), F.sum("n").over(Window.partitionBy()).alias("total"))
    room = F.floor(F.col("total") * share)
    dated = train.join(F.broadcast(years), "first_year", "left")
    whole = F.col("later") + F.col("n") <= room
    cut = dated.filter((F.col("later") < room) & ~whole).withColumn("head", F.substring("u", 1, 4))
    sizes = cut.groupBy("head").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("head", (F.sum("m").over(Window.orderBy("head")) - F.col("m")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("head").orderBy("u", "v"))
    placed = cut.withColumn("rank", rank).join(sizes, "head").withColumn("slice", F.when(F.col("later") + F.col("before") + F.col("rank") <= room, "validate").otherwise("fit"))
    rest = dated.filter(F.coalesce((F.col("later") >= room) | whole, F.lit(True))).withColumn("slice", F.when(whole, "validate").otherwise("fit"))
    return rest.select("u", "v", "first_year", "slice").unionByName(placed.select("u", "v", "first_year", "slice"))
