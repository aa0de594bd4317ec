"""Scores of evidence, hypotheses and assessments, as aggregations and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def weighted(parts: dict[str, float]) -> Column:
    """Weighted mean of the columns that are not null, clipped to 0..1; null if all are."""
    top = bottom = F.lit(0.0)
    for name, w in parts.items():
        top = top + F.coalesce(F.col(name) * w, F.lit(0.0))
        bottom = bottom + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return F.when(bottom > 0, clip(top / bottom))


def majority(votes: DataFrame, voters: int) -> DataFrame:
    """(doc_id, key, votes, confidence, label) of (doc_id, text, label, confidence): texts with at least half the voters plus one.

    The confidence is the mean times the share of voters; the label is the most confident's.
    """
    x = votes.groupBy("doc_id", F.lower(F.trim("text")).alias("key")).agg(F.count(F.lit(1)).alias("votes"), F.avg("confidence").alias("c"), F.max(F.struct("confidence", "label")).alias("top"))
    return x.filter(F.col("votes") >= voters // 2 + 1).select("doc_id", "key", "votes", (F.col("c") * F.least(F.col("votes") / voters, F.lit(1.0))).alias("confidence"), F.col("top.label").alias("label"))


def uncertainty(members: DataFrame) -> DataFrame:
    """(item, total, aleatoric, epistemic) of (item, member, class, p): entropy of the mean, mean entropy, their difference."""
    h = lambda p: -p * F.log(p + 1e-12)
    n = members.withColumn("q", F.col("p") / F.sum("p").over(Window.partitionBy("item", "member")))
    count = n.groupBy("item").agg(F.countDistinct("member").alias("k"), F.sum(h(F.col("q"))).alias("s"))
    mean = n.groupBy("item", "class").agg(F.sum("q").alias("q")).join(count.select("item", "k"), "item").groupBy("item").agg(F.sum(h(F.col("q") / F.col("k"))).alias("total"))
    x = mean.join(count, "item").withColumn("aleatoric", F.col("s") / F.col("k"))
    return x.select("item", "total", "aleatoric", F.greatest(F.lit(0.0), F.col("total") - F.col("aleatoric")).alias("epistemic"))


def consensus(ratings: DataFrame) -> DataFrame:
    """Expert consensus of (item, rating, confidence): mean weighted by confidence (0 counts as 1), mean, population deviation, modal rating."""
    w = F.when(F.col("confidence") == 0, 1.0).otherwise(F.col("confidence"))
    mode = ratings.groupBy("item", "rating").agg(F.count(F.lit(1)).alias("n")).groupBy("item").agg(F.min_by("rating", F.struct((-F.col("n")).alias("n"), F.col("rating"))).alias("mode"))
    x = ratings.groupBy("item").agg((F.sum(F.col("rating") * w) / F.sum(w)).alias("weighted"), F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("deviation"), F.count(F.lit(1)).alias("n"))
    return x.join(mode, "item")


def literature_confidence(evidence: DataFrame) -> DataFrame:
    """(item, confidence) of (item, confidence, citations): 0.60 mean + 0.25 n / (n + 1) + 0.15 min(ln(1 + citations) / ln 101, 1)."""
    x = evidence.groupBy("item").agg(F.avg("confidence").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("citations").alias("c"))
    return x.select("item", clip(0.6 * F.col("m") + 0.25 * F.col("n") / (F.col("n") + 1) + 0.15 * F.least(F.log1p("c") / F.log(F.lit(101.0)), F.lit(1.0))).alias("confidence"))


def experimental_confidence(studies: DataFrame) -> DataFrame:
    """(item, confidence) of (item, design, significance, power): 0.7 best + 0.3 mean of 0.4 design + 0.4 significance + 0.2 power."""
    s = 0.4 * F.col("design") + 0.4 * F.col("significance") + 0.2 * F.col("power")
    return studies.groupBy("item").agg((0.7 * F.max(s) + 0.3 * F.avg(s)).alias("confidence"))


#: Plausibility of unordered type pairs, and multipliers of predicates.
PAIR_PRIORS = {
    ("GENE", "DISEASE"): 0.8,
    ("DRUG", "DISEASE"): 0.9,
    ("DRUG", "GENE"): 0.7,
    ("PROTEIN", "DISEASE"): 0.8,
    ("PATHWAY", "DISEASE"): 0.6,
    ("GENE", "GENE"): 0.5,
    ("PROTEIN", "PROTEIN"): 0.6,
    ("MUTATION", "DISEASE"): 0.8,
    ("MUTATION", "DRUG"): 0.7,
    ("MUTATION", "GENE"): 0.6,
    ("MUTATION", "PHENOTYPE"): 0.6,
    ("MUTATION", "MUTATION"): 0.5,
    ("FUSION", "DISEASE"): 0.8,
    ("FUSION", "DRUG"): 0.7,
    ("PHENOTYPE", "DISEASE"): 0.7,
}
RELATION_FACTORS = {"TREATS": 1.2, "CAUSES": 1.1, "PREVENTS": 1.1, "INHIBITS": 1.0, "ACTIVATES": 1.0, "INTERACTS_WITH": 0.9, "ASSOCIATED_WITH": 0.8}


def plausibility(a: Column, b: Column, predicate: Column) -> Column:
    """Pair prior (0.3 if unknown) times the predicate's factor (1 if unknown), at most 1."""
    prior, factor = F.lit(0.3), F.lit(1.0)
    for (x, y), p in PAIR_PRIORS.items():
        prior = F.when((F.least(a, b) == min(x, y)) & (F.greatest(a, b) == max(x, y)), p).otherwise(prior)
    for k, f in RELATION_FACTORS.items():
        factor = F.when(predicate == k, f).otherwise(factor)
    return F.least(F.lit(1.0), prior * factor)


def hypothesis_priority(confidence: Column, novelty: Column, feasibility: Column, evidence: Column) -> Column:
    return 0.4 * confidence + 0.3 * novelty + 0.2 * feasibility + 0.1 * F.least(evidence / 3, F.lit(1.0))


def trend(findings: DataFrame, recent_from: int) -> DataFrame:
    """(item, recent, historic, trend, score) of (item, year, supports): shares of support, a trend beyond 0.1, and their blend.

    Undated findings are historic. Without findings of one period its share is 0.5; score is
    0.7 recent + 0.3 historic, times 1.1 if rising and 0.9 if falling.
    """
    new = F.coalesce(F.col("year") >= recent_from, F.lit(False))
    share = lambda c: F.coalesce(F.avg(F.when(c, F.col("supports").cast("double"))), F.lit(0.5))
    x = findings.groupBy("item").agg(share(new).alias("recent"), share(~new).alias("historic"))
    gap = F.col("recent") - F.col("historic")
    t = F.when(gap > 0.1, "rising").when(gap < -0.1, "falling").otherwise("stable")
    f = F.when(gap > 0.1, 1.1).when(gap < -0.1, 0.9).otherwise(1.0)
    return x.select("item", "recent", "historic", t.alias("trend"), clip((0.7 * F.col("recent") + 0.3 * F.col("historic")) * f).alias("score"))


def moving_performance(results: DataFrame, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """(agent, success, seconds, routing) of (agent, pos, ok, confidence, took): exponential averages in order of pos.

    The average is the sum of alpha * (1 - alpha)^k over results, k counting those after it, so
    it is aggregated; ranks are taken in two steps, within and across hash-free ranges of pos,
    and no agent's results meet in one task. The routing score is success * mean confidence
    - min(seconds / 10, 0.5).
    """
    x = results.withColumn("range", F.floor(F.col("pos") / 4096))
    sizes = x.groupBy("agent", "range").agg(F.count(F.lit(1)).alias("n"))
    after = F.sum("n").over(Window.partitionBy("agent").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("agent", "range", F.coalesce(after, F.lit(0)).alias("after"))
    rank = F.row_number().over(Window.partitionBy("agent", "range").orderBy(F.desc("pos"))) - 1
    k = F.col("rank") + F.col("after")
    weighed = x.withColumn("rank", rank).join(sizes, ["agent", "range"]).withColumn("w", alpha * F.pow(F.lit(1 - alpha), k))
    y = weighed.groupBy("agent").agg(
        (F.sum(F.col("w") * F.col("ok").cast("double")) + start * F.pow(F.lit(1 - alpha), F.count(F.lit(1)))).alias("success"), F.sum(F.col("w") * F.col("took").cast("double")).alias("seconds"), F.avg("confidence").alias("c")
    )
    return y.select("agent", "success", "seconds", (F.col("success") * F.col("c") - F.least(F.col("seconds") / 10, F.lit(0.5))).alias("routing"))


def route(text: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], other: str = "general") -> Column:
    """The first rule one of whose cues the lower-case text holds."""
    out = None
    low = F.lower(F.coalesce(text, F.lit("")))
    for name, cues in rules:
        hit = F.lit(False)
        for c in cues:
            hit = hit | F.contains(low, F.lit(c))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def usage(calls: DataFrame) -> DataFrame:
    """(provider, model, calls, tokens) with subtotals, '*' standing for all."""
    x = calls.rollup("provider", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("long").alias("tokens"), F.grouping("provider").alias("gp"), F.grouping("model").alias("gm"))
    return x.select(F.when(F.col("gp") == 1, "*").otherwise(F.col("provider")).alias("provider"), F.when(F.col("gm") == 1, "*").otherwise(F.col("model")).alias("model"), "calls", "tokens")


def emergence(events: DataFrame, width: int, least: int = 2) -> DataFrame:
    """(entity, windows, first, last) of (entity, t): entities seen in at least ``least`` windows floor(t / width) * width."""
    w = (F.floor(F.col("t") / width) * width).cast("int")
    x = events.groupBy("entity", w.alias("w")).agg(F.count(F.lit(1)).alias("_")).groupBy("entity").agg(F.count(F.lit(1)).alias("windows"), F.min("w").alias("first"), F.max("w").alias("last"))
    return x.filter(F.col("windows") >= least)
