"""Ranking metrics over (group, score, is_pos), ties counted against the positive.

Ranks come from one row per distinct score of a group, so a block of ties costs one row,
and cumulative counts replace comparisons of positives with negatives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HITS = (1, 5, 10, 100)


def score_levels(scored: DataFrame, *group: str) -> DataFrame:
    """(group, score, pos, neg, beaten): per distinct score, its positives, negatives, and lower negatives."""
    level = scored.groupBy(*group, "score").agg(F.sum(F.col("is_pos").cast("long")).alias("pos"), F.sum((~F.col("is_pos")).cast("long")).alias("neg"))
    below = Window.partitionBy(*group).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    return level.withColumn("beaten", F.coalesce(F.sum("neg").over(below), F.lit(0)))


def ranking(scored: DataFrame, *group: str) -> DataFrame:
    """AUC, MRR, hits at 1, 5, 10 and 100, and the share of indistinguishable positives, per group.

    A positive's rank is the number of higher negatives and ties, plus 1. Groups without
    positives or without negatives have null metrics.
    """
    levels = score_levels(scored, *group)
    total = F.sum("neg").over(Window.partitionBy(*group))
    x = levels.withColumn("n", total).filter("pos > 0").withColumn("rank", F.col("n") - F.col("beaten") + 1)
    p = F.sum("pos")
    hits = [F.round(F.sum(F.when(F.col("rank") <= k, F.col("pos")).otherwise(0)) / p, 6).alias(f"hits_{k}") for k in HITS]
    return x.groupBy(*group).agg(
        p.alias("n_pos"),
        F.max("n").alias("n_neg"),
        F.round(F.when(F.max("n") > 0, F.sum(F.col("pos") * (2 * F.col("beaten") + F.col("neg"))) / (2.0 * p * F.max("n"))), 6).alias("auc"),
        F.round(F.sum(F.col("pos") / F.col("rank")) / p, 6).alias("mrr"),
        *hits,
        F.round(F.sum(F.when(2 * F.col("neg") > F.col("n"), F.col("pos")).otherwise(0)) / p, 6).alias("indistinct"),
    )


def average_precision(scored: DataFrame, *group: str) -> DataFrame:
    """(group, ap): precision at each distinct threshold, weighted by the gain in recall."""
    level = scored.groupBy(*group, "score").agg(F.sum(F.col("is_pos").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy(*group).orderBy(F.desc("score"))
    x = level.withColumn("tp", F.sum("pos").over(down)).withColumn("seen", F.sum("n").over(down))
    return x.groupBy(*group).agg(F.round(F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos"), 6).alias("ap"))


def bootstrap(scored: DataFrame, *group: str, resamples: int = 500, seed: int = 0) -> DataFrame:
    """AUC with a 95 % percentile interval over resamples of the positives.

    A positive's weight in a resample is Poisson with mean 1, drawn from a hash of its
    score level, so resamples need no join: each level carries its positives as a count.
    """
    levels = score_levels(scored, *group).withColumn("n", F.sum("neg").over(Window.partitionBy(*group))).filter("pos > 0 AND n > 0")
    each = levels.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pos")))).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    u = F.pmod(F.xxhash64(F.lit(seed), "score", "copy", "b"), F.lit(1 << 30)) / float(1 << 30)
    w, tail, weight = 0.36787944117144233, 0.0, F.lit(8)
    cuts = []
    for k in range(8):
        tail += w
        cuts.append((k, tail))
        w /= k + 1
    for k, cut in reversed(cuts):
        weight = F.when(u < cut, k).otherwise(weight)
    part = each.withColumn("weight", weight).withColumn("c", (F.col("beaten") + 0.5 * F.col("neg")) / F.col("n"))
    auc = part.groupBy(*group, "b").agg((F.sum(F.col("weight") * F.col("c")) / F.sum("weight")).alias("auc"))
    return auc.groupBy(*group).agg(F.avg("auc").alias("mean"), F.expr("percentile(auc, array(0.025, 0.975))").alias("interval")).select(*group, F.round("mean", 6).alias("mean"), F.round(F.col("interval")[0], 6).alias("low"), F.round(F.col("interval")[1], 6).alias("high"))


def percentiles(queries: DataFrame, reference: DataFrame, *group: str) -> DataFrame:
    """``queries`` with pct, the midpoint percentile of score among the reference's; 0 for an empty reference."""
    both = queries.groupBy(*group, "score").agg(F.lit(0).cast("long").alias("r")).unionByName(reference.groupBy(*group, "score").agg(F.count(F.lit(1)).alias("r")))
    level = both.groupBy(*group, "score").agg(F.sum("r").alias("r"))
    by = Window.partitionBy(*group)
    below = F.coalesce(F.sum("r").over(by.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pct = level.withColumn("total", F.sum("r").over(by)).withColumn("pct", F.when(F.col("total") > 0, (2 * below + F.col("r")) / (2.0 * F.col("total"))).otherwise(0.0))
    return queries.join(pct.select(*group, "score", "pct"), [*group, "score"])


def precision_at(ranked: DataFrame, depths: tuple[int, ...], rank: str = "rank", hit: str = "hit") -> DataFrame:
    """(depth, hits, precision, lift) at each depth of a ranking; lift is against the share of hits in all of it."""
    top = ranked.filter(F.col(rank) <= max(depths))
    sums = [F.sum(F.when((F.col(rank) <= d) & F.col(hit), 1).otherwise(0)).alias(f"h{d}") for d in depths]
    row = top.agg(*sums).join(F.broadcast(ranked.agg(F.avg(F.col(hit).cast("double")).alias("base"), F.count(F.lit(1)).alias("n"))))
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"h{d}").alias("hits")) for d in depths])).alias("x")
    x = row.select(rows, "base", "n").select("x.*", "base", "n").withColumn("precision", F.col("hits") / F.least("depth", "n"))
    return x.select("depth", F.coalesce("hits", F.lit(0)).alias("hits"), F.round("precision", 6).alias("precision"), F.round(F.try_divide("precision", "base"), 6).alias("lift"))


def classification(rows: DataFrame, *group: str, threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 and Brier score of (label 0/1, score)."""
    hat, y = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    c = rows.groupBy(*group).agg(n(hat & y).alias("tp"), n(hat & ~y).alias("fp"), n(~hat & y).alias("fn"), n(~hat & ~y).alias("tn"), F.avg((F.col("score") - F.col("label")) ** 2).alias("brier"))
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    zero = lambda e: F.round(F.coalesce(e, F.lit(0.0)), 6)
    f1 = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(*group, "tp", "fp", "fn", "tn", zero((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), zero(p).alias("precision"), zero(r).alias("recall"), zero(f1).alias("f1"), F.round("brier", 6).alias("brier"))
