"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all rates per document in [0, cap], the mix takes those nearest to 1 in
Kullback-Leibler divergence whose words meet each source's target. The dual has
one multiplier a source and the optimum is exponentially tilted by size:
rate = min(cap, exp(multiplier * size / mean size)). Newton iterations run over
the (source, size) histogram; rates are then rounded into whole copies.

The histogram of a source has at most sqrt(2 * words) entries, since its sizes
differ; it is folded in parts. Documents are never gathered by source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed

#: ASCII white space separates words.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Targets per source of (source, source_size): weights repeat over the sources by code point, null last.

    ``share`` of all words is dealt by weight; a target stops at ``cap`` times its
    source's size and the excess goes to the others by weight, until none is above.
    With x the words per weight unit, target = min(cap * size, weight * x): sources fill up
    in the order of size / weight, so one pass over that order finds x.
    One row a source; the window over all of them carries one row a source too.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    ranked = sizes.withColumn("weight", w).withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("goal") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    # the first source that its level does not fill fixes the level of all after it
    open_ = ranked.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level")))
    found = F.first("level", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    full = cap * F.col("source_size").cast("double")
    return open_.withColumn("target", F.least(full, F.coalesce(found * F.col("weight"), full))).select("source", "source_size", "target")


def balance(hist: DataFrame, targets: DataFrame, cap: float, iterations: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Multipliers (source, theta) that meet the targets, by safeguarded Newton steps.

    Each step is one aggregation of the histogram by source; a step that leaves the
    bracket of the root is replaced by its middle. A target of 0 or of cap * size
    has its root at an end of the bracket and is met by rates of 0 or cap.
    """
    state = checkpointed(targets.select("source", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(0.0).alias("theta"), F.lit(False).alias("done")))
    bins = hist.select(F.col("source").alias("bin_source"), "size", "n_docs")
    x = F.col("size") / F.col("mean")
    for _ in range(iterations):
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("theta") * x, F.lit(50.0))))
        sums = (
            bins.join(state, F.col("bin_source").eqNullSafe(F.col("source"))).select("source", "target", "mean", "lo", "hi", "theta", "done", (F.col("n_docs") * F.col("size")).alias("words"), rate.alias("rate"), x.alias("x"))
            .groupBy("source", "target", "mean", "lo", "hi", "theta", "done")
            .agg(F.sum(F.col("words") * F.col("rate")).alias("got"), F.sum(F.when(F.col("rate") < cap, F.col("words") * F.col("rate") * F.col("x")).otherwise(0.0)).alias("slope"))
        )
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("theta")), F.when(over, F.col("theta")).otherwise(F.col("hi"))
        newton = F.col("theta") - F.try_divide(F.col("got") - F.col("target"), F.col("slope"))
        step = F.when((newton > F.col("lo2")) & (newton < F.col("hi2")), newton).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.greatest(F.col("target"), F.lit(1.0))
        state = checkpointed(
            sums.withColumn("lo2", lo).withColumn("hi2", hi).withColumn("done", F.col("done") | near | (F.col("hi2") - F.col("lo2") < 1e-12))
            .select("source", "target", "mean", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.when(F.col("done"), F.col("theta")).otherwise(step).alias("theta"), "done")
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state


def rounded(hist: DataFrame, cap: int, fold: int = 256) -> DataFrame:
    """Whole copies ``take`` of each (source, size, n_docs, rate), near its words in each source.

    Sizes are folded from the largest down, ``fold`` at a time; what a size's rounding leaves
    is carried, in words, to the smaller ones of its part, and what all other parts leave to
    the part of the smallest sizes. So a source ends within half of its smallest sizes, and
    no row or task holds more than one part.
    """
    # ranks in two steps, within and across ranges of at most 2^8 sizes
    ranged = hist.withColumn("range", F.shiftright("size", 8))
    per = ranged.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    larger = Window.partitionBy("source").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("source").alias("rs"), F.col("range").alias("rr"), F.coalesce(F.sum("n").over(larger), F.lit(0)).alias("above"), F.sum("n").over(Window.partitionBy("source")).alias("all"))
    place = F.row_number().over(Window.partitionBy("source", "range").orderBy(F.desc("size"))) - 1
    ranked = ranged.withColumn("place", place).join(per, F.col("source").eqNullSafe(F.col("rs")) & (F.col("range") == F.col("rr")))
    # the last part is that of the smallest sizes and is full
    part = F.floor((F.col("all") - 1 - F.col("place") - F.col("above")) / fold)
    item = F.struct(F.col("size"), F.col("n_docs"), F.col("rate"))
    parts = checkpointed(ranked.groupBy("source", part.alias("part")).agg(F.sort_array(F.collect_list(item), asc=False).alias("bins")))
    take = f"CAST(least({cap} * b.n_docs, greatest(0, CAST(round(b.n_docs * b.rate + acc.carry / b.size) AS bigint))) AS bigint)"
    step = f"""(acc, b) -> CASE WHEN b.size = 0 THEN struct(acc.carry AS carry, concat(acc.out, array(struct(b.size AS size, CAST(b.n_docs AS bigint) AS take))) AS out)
        ELSE struct(acc.carry + b.size * (b.n_docs * b.rate - {take}) AS carry, concat(acc.out, array(struct(b.size AS size, {take} AS take))) AS out) END"""
    folded = lambda df: df.withColumn("done", F.expr(f"aggregate(bins, start, {step})"))
    start = lambda carry: F.struct(carry.alias("carry"), F.expr("CAST(array() AS array<struct<size:bigint,take:bigint>>)").alias("out"))
    large = checkpointed(folded(parts.filter("part > 0").withColumn("start", start(F.lit(0.0)))).select("source", "done"))
    left = large.groupBy(F.col("source").alias("ls")).agg(F.sum("done.carry").alias("left"))
    small = parts.filter("part = 0").join(left, F.col("source").eqNullSafe(F.col("ls")), "left")
    small = folded(small.withColumn("start", start(F.coalesce("left", F.lit(0.0))))).select("source", "done")
    out = large.unionByName(small).select("source", F.explode("done.out").alias("b"))
    return out.select("source", F.col("b.size").alias("size"), F.col("b.take").alias("take"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, group: int = 1024) -> DataFrame:
    """Copies of every document so that each source's words come near its target.

    Returns doc_id, source, size, source_size (long), target (double), copies (int) and
    taken = copies * size (long), one row per input row. A null text has size 0 and is
    taken once (0 words). Null sources form one source, after the others. Rows alike in
    id, source and text are told apart arbitrarily, so the set of results is the same in
    every run. An empty table gives no rows; other columns are ignored.
    """
    # ids and sizes only: the texts are read once
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id"), F.col("text")).alias("draw"))
    base = checkpointed(base)
    hist = checkpointed(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n_docs")))
    sizes = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).cast("long").alias("source_size"), F.sum("n_docs").alias("n"))
    targets = checkpointed(source_targets(sizes, weights, share, cap).alias("t").join(sizes.select(F.col("source").alias("s2"), "n"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2"))
    positive = hist.filter(F.col("size") > 0)
    theta = balance(positive, targets.filter(F.col("source_size") > 0), cap)
    th = theta.select(F.col("source").alias("s3"), "theta", "mean")
    rates = hist.join(th, F.col("source").eqNullSafe(F.col("s3")), "left").withColumn("rate", F.coalesce(F.least(F.lit(float(cap)), F.exp(F.least(F.col("theta") * F.col("size") / F.col("mean"), F.lit(50.0)))), F.lit(1.0)))
    take = rounded(rates.select("source", "size", "n_docs", "rate"), cap).select(F.col("source").alias("s4"), F.col("size").alias("z4"), "take")
    plan = hist.join(take, F.col("source").eqNullSafe(F.col("s4")) & (F.col("size") == F.col("z4"))).drop("s4", "z4")
    plan = plan.withColumn("groups", F.ceil(F.col("n_docs") / group).cast("long"))
    goal = targets.select(F.col("source").alias("s5"), "source_size", "target")
    plan = plan.join(goal, F.col("source").eqNullSafe(F.col("s5"))).drop("s5")
    p = checkpointed(plan.select(F.col("source").alias("ps"), F.col("size").alias("pz"), "n_docs", "take", "groups", "source_size", "target"))
    keyed = base.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pz"))).drop("ps", "pz").withColumn("part", F.pmod(F.col("draw"), F.col("groups")))
    # documents of one size in one source differ by at most one copy; who gets it is decided by a hash, in parts of bounded size
    odd = keyed.filter((F.col("take") % F.col("n_docs")) != 0)
    parts = odd.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("m"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("qs"), F.col("size").alias("qz"), F.col("part").alias("qp"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    rank = Window.partitionBy("source", "size", "part").orderBy("draw", "doc_id")
    odd = odd.withColumn("rank", F.row_number().over(rank))
    odd = odd.join(parts, F.col("source").eqNullSafe(F.col("qs")) & (F.col("size") == F.col("qz")) & (F.col("part") == F.col("qp")))
    each = F.floor(F.col("take") / F.col("n_docs"))
    extra = F.col("take") - each * F.col("n_docs")
    odd = odd.withColumn("copies", each + F.when(F.col("rank") + F.col("ahead") <= extra, 1).otherwise(0))
    even = keyed.filter((F.col("take") % F.col("n_docs")) == 0).withColumn("copies", each)
    cols = ["doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken")]
    return odd.select(*cols).unionByName(even.select(*cols))
