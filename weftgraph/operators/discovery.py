"""Bridges, variant scores, mentions in sentences, novelty, outcomes, validation and report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import null_if_blank


def bridge_papers(evidence: DataFrame, most: int = 30, least: int = 1) -> DataFrame:
    """(disease, profile, paper): papers of a disease's other profiles that aren't the profile's own.

    Evidence is (disease, profile, paper). Diseases have 2 to ``most`` profiles; a profile needs
    ``least`` such papers.
    """
    own = evidence.select("disease", "profile", "paper").distinct()
    profiles = own.select("disease", "profile").distinct()
    wanted = profiles.groupBy("disease").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most)).select("disease")
    reach = profiles.join(wanted, "disease", "left_semi").join(own.select("disease", "paper").distinct(), "disease")
    bridge = reach.join(own, ["disease", "profile", "paper"], "left_anti")
    enough = bridge.groupBy("disease", "profile").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("disease", "profile")
    return bridge.join(enough, ["disease", "profile"], "left_semi")


def named_relations(questions: DataFrame, edges: DataFrame, k: int = 4) -> DataFrame:
    """(query_id, rank, u, v, predicate): relations of nodes that a question (query_id, text) names, one a neighbour, first ``k``.

    A node is named by its id as whole words, in any case; ids are looked up among the question's
    word runs of up to four words. Order is by neighbour.
    """
    w = questions.select("query_id", F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}_#:]+)"), 1).alias("w"))
    runs = None
    for n in range(1, 5):
        one = w.filter(F.size("w") >= n).select("query_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - n), _run(n))).alias("key"))
        runs = one if runs is None else runs.unionByName(one)
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("nbr"), "u", "v", "predicate").unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("nbr"), "u", "v", "predicate"))
    hit = runs.distinct().join(both.withColumn("key", F.lower("node")), "key")
    first = hit.groupBy("query_id", "nbr").agg(F.min(F.struct("u", "v", "predicate")).alias("e"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nbr"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "e.u", "e.v", "e.predicate")


def _run(n: int):
    return lambda i: F.array_join(F.slice(F.col("w"), i + 1, n), " ")


def variant_key(gene: Column, change: Column) -> Column:
    """'GENE p.V600E' of a protein change of one letter, digits, and a letter or star; else null."""
    return F.when(change.rlike("^[A-Z][0-9]+[A-Z*]$"), F.concat(F.upper(gene), F.lit(" p."), change))


def variant_scores(counts: DataFrame, cases: DataFrame, nodes: DataFrame, diseases: DataFrame, mode: str = "specificity") -> DataFrame:
    """(u, v, score) of variant node and disease: the strongest cohort's share.

    Counts are (key, cohort, n), cases (cohort, cases), nodes (node, key), diseases (cohort, disease).
    Specificity is n over the variant's sum, prevalence n over the cohort's cases; cohorts without
    a disease, and those without cases for prevalence, have none.
    """
    if mode not in ("specificity", "prevalence"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "specificity":
        total = counts.groupBy("key").agg(F.sum("n").alias("total"))
        x = counts.join(total, "key")
    else:
        x = counts.join(cases.select("cohort", F.col("cases").alias("total")), "cohort")
    x = x.filter("total > 0").join(diseases, "cohort").join(nodes, "key")
    return x.groupBy(F.col("node").alias("u"), F.col("disease").alias("v")).agg(F.max(F.col("n") / F.col("total")).alias("score"))


def score_pairs(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(u, v, score) of every pair, in either direction the larger; 0 where there is none."""
    either = scores.unionByName(scores.select(F.col("v").alias("u"), F.col("u").alias("v"), "score")).groupBy("u", "v").agg(F.max("score").alias("score"))
    return pairs.select("u", "v").join(either, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))


def node_text(name: Column, gene: Column) -> Column:
    """The name, after its gene unless it begins with it in any case or has none; null for a blank name."""
    n, g = F.trim(name), F.trim(null_if_blank(gene))
    return F.when(n != "", F.when((F.coalesce(g, F.lit("")) == "") | F.startswith(F.upper(n), F.upper(g)), n).otherwise(F.concat_ws(" ", g, n)))


def mention_pattern(name: Column) -> Column:
    """A regular expression, for lower-case text, of a name with any separators, or its last part alone if that is 2 characters or longer; null without parts."""
    quoted = F.transform(F.filter(F.split(F.lower(F.trim(name)), "[\\s\\-_:]+"), lambda t: t != ""), lambda t: F.regexp_replace(t, "([^\\p{L}\\p{N}])", "\\\\$1"))
    whole = F.array_join(quoted, "[\\s\\-_:]*")
    last = F.element_at(quoted, -1)
    both = F.when((F.size(quoted) > 1) & (F.length(last) >= 2), F.concat_ws("|", whole, last)).otherwise(whole)
    edge = "[\\p{L}\\p{N}_]"
    return F.when(F.size(quoted) > 0, F.concat(F.lit(f"(?<!{edge})("), both, F.lit(f")(?!{edge})")))


def sentences_mentioning(text: Column, name: Column) -> Column:
    """Sentences of 21 to 599 characters that mention the name."""
    parts = F.split(F.regexp_replace(text, "([.!?])\\s+", "$1\u0002"), "\u0002")
    bound = F.array(F.struct(parts.alias("s"), mention_pattern(name).alias("p")))  # an array of one, so that neither is made again for each sentence
    return F.transform(bound, lambda z: F.filter(F.transform(z["s"], lambda s: F.trim(s)), lambda s: F.length(s).between(21, 599) & F.regexp_like(F.lower(s), z["p"])))[0]


def query_term(name: Column) -> Column:
    """The name in quotes, signs but - + . as spaces; '' if nothing is left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, "[^\\p{L}\\p{N}_\\s\\-+.]", " "), "\\s+", " "))
    return F.when(clean != "", F.concat(F.lit('"'), clean, F.lit('"'))).otherwise("")


def context_text(name: Column, sentences: Column, most: int = 12) -> Column:
    """The name and its first sentences, joined by spaces."""
    return F.concat_ws(" ", name, F.array_join(F.slice(sentences, 1, most), " "))


def novelty(pairs: DataFrame, knowledge: DataFrame) -> DataFrame:
    """(u, v, novelty) of pairs against known partners (entity, partner).

    0 if either knows the other, 0.5 if neither knows anyone, else 0.5 + 0.5 * min(most partners / 10, 1).
    """
    k = knowledge.select("entity", "partner").distinct()
    size = k.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    known = k.select(F.col("entity").alias("u"), F.col("partner").alias("v")).unionByName(k.select(F.col("partner").alias("u"), F.col("entity").alias("v"))).distinct().withColumn("known", F.lit(True))
    x = pairs.join(size.select(F.col("entity").alias("u"), F.col("n").alias("nu")), "u", "left").join(size.select(F.col("entity").alias("v"), F.col("n").alias("nv")), "v", "left").join(known, ["u", "v"], "left")
    most = F.greatest(F.coalesce("nu", F.lit(0)), F.coalesce("nv", F.lit(0)))
    return x.select("u", "v", F.when(F.col("known"), 0.0).when(most == 0, 0.5).otherwise(0.5 + 0.5 * F.least(most / 10, F.lit(1.0))).alias("novelty"))


def known_labels(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(u, v, relation, label): 1 if the relation is known in either direction, else 0."""
    k = known.select("u", "v", "relation").unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v"), "relation")).distinct().withColumn("label", F.lit(1))
    return pairs.select("u", "v", "relation").join(k, ["u", "v", "relation"], "left").select("u", "v", "relation", F.coalesce("label", F.lit(0)).alias("label"))


def later_labels(predictions: DataFrame, mentions: DataFrame, cutoff: int) -> DataFrame:
    """(u, v, label): 1 for predictions whose ends are both in a paper (paper, year, entity) from the cutoff on."""
    late = mentions.filter(F.col("year") >= cutoff).select("paper", "entity").distinct()
    p = predictions.select("u", "v").distinct()
    met = p.join(late.select(F.col("entity").alias("u"), "paper"), "u").join(late.select(F.col("entity").alias("v"), "paper"), ["v", "paper"]).select("u", "v").distinct().withColumn("label", F.lit(1))
    return predictions.select("u", "v").join(met, ["u", "v"], "left").select("u", "v", F.coalesce("label", F.lit(0)).alias("label"))


def endpoint_evidence(predictions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows (name, ...) of either end of each prediction (u, v), names in upper case; a row that names both counts twice."""
    e = evidence.withColumn("key", F.upper("name"))
    side = lambda c: predictions.select("u", "v", F.upper(c).alias("key")).join(e, "key").drop("key")
    return side("u").unionByName(side("v"))


def outcome_rates(assessed: DataFrame) -> DataFrame:
    """(type_pair, pairs, rate, lift, mean_hit, mean_miss) of (type_pair, score, hit): curated shares, against that of all, and mean scores by outcome."""
    hit = F.col("hit").cast("double")
    base = assessed.agg(F.avg(hit).alias("base"))
    x = assessed.groupBy("type_pair").agg(F.count(F.lit(1)).alias("pairs"), F.avg(hit).alias("rate"), F.avg(F.when(F.col("hit"), F.col("score"))).alias("mean_hit"), F.avg(F.when(~F.col("hit"), F.col("score"))).alias("mean_miss"))
    return x.join(F.broadcast(base)).select("type_pair", "pairs", "rate", F.try_divide("rate", "base").alias("lift"), "mean_hit", "mean_miss")


def dedupe_relations(relations: DataFrame, order: str) -> DataFrame:
    """One row per unordered pair of (u, v), the first by ``order``."""
    key = [F.least("u", "v"), F.greatest("u", "v")]
    cols = relations.columns
    x = relations.groupBy(key[0].alias("_a"), key[1].alias("_b")).agg(F.min_by(F.struct(*cols), order).alias("r"))
    return x.select("r.*")


def bands(rows: DataFrame, *group: str) -> DataFrame:
    """Mean, population deviation, and counts of scores from 0.8, 0.6, 0.4 on and below, per group; ``high`` counts those from 0.7 on."""
    s = F.col("score")
    n = lambda c: F.count_if(c)
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("deviation"), n(s >= 0.7).alias("high"),
        n(s >= 0.8).alias("very_high_band"), n((s >= 0.6) & (s < 0.8)).alias("high_band"), n((s >= 0.4) & (s < 0.6)).alias("middle_band"), n(s < 0.4).alias("low_band"),
    )


def percentile_interval(scores: DataFrame, *group: str, level: float = 0.95) -> DataFrame:
    """(group, low, high): the percentile interval of the scores; no rows for no scores."""
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    cut = (1 - level) / 2
    x = scores.groupBy(*group).agg(F.percentile("score", F.array(F.lit(cut), F.lit(1 - cut))).alias("q"))
    return x.filter("q IS NOT NULL").select(*group, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def fold_metrics(rows: DataFrame, fold: Column, threshold: float = 0.5) -> DataFrame:
    """(fold, n, precision, recall, f1) of (label, score) by fold; a metric without cases is 0."""
    hat, y = F.col("score") >= threshold, F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    c = rows.groupBy(fold.alias("fold")).agg(F.count(F.lit(1)).alias("n"), n(hat & y).alias("tp"), n(hat & ~y).alias("fp"), n(~hat & y).alias("fn"))
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    return c.select(
        "fold", "n", zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"), zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))).alias("recall"),
        zero(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
    )


def class_metrics(rows: DataFrame) -> DataFrame:
    """(classes, accuracy, macro_f1, weighted_f1) of (label, predicted), from the confusion counts."""
    c = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    per = c.select(F.col("label").alias("k"), F.col("n").alias("true"), F.lit(0).alias("said"), F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    per = per.unionByName(c.select(F.col("predicted").alias("k"), F.lit(0).alias("true"), F.col("n").alias("said"), F.lit(0).alias("hit")))
    x = per.groupBy("k").agg(F.sum("true").alias("true"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    f1 = 2 * F.col("hit") / (F.col("true") + F.col("said"))
    return x.agg(F.count(F.lit(1)).alias("classes"), (F.sum("hit") / F.sum("true")).alias("accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("true")) / F.sum("true")).alias("weighted_f1"))


def regression_metrics(rows: DataFrame) -> DataFrame:
    """(mae, mse, rmse, pearson) of (label, score); an undefined correlation is 0."""
    e = F.col("score") - F.col("label")
    p = F.corr("label", "score")
    return rows.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.when(p.isNull() | F.isnan(p), 0.0).otherwise(p).alias("pearson"))


def recency(year: Column, cutoff: int) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - (cutoff - 30)) / 30))


def literature_check(share: Column, n: Column) -> Column:
    """0.5 + (share of support - 0.5) * min(n / 5, 1)."""
    return 0.5 + (share - 0.5) * F.least(n / 5, F.lit(1.0))


def biology_check(confidence: Column, has_mechanism: Column, n: Column) -> Column:
    """0.6 confidence + 0.25 for a mechanism + 0.15 min(n / 4, 1)."""
    return 0.6 * confidence + F.when(has_mechanism, 0.25).otherwise(0.0) + 0.15 * F.least(n / 4, F.lit(1.0))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.7, "supported").when(score <= 0.3, "contradicted").otherwise("inconclusive")


def assessment(literature_f1: Column, temporal_f1: Column) -> Column:
    """0.5 and what each F1 adds: 0.2 above 0.7 or 0.1 above 0.5, and 0.15 above 0.6 or 0.05 above 0.4."""
    return 0.5 + F.when(literature_f1 > 0.7, 0.2).when(literature_f1 > 0.5, 0.1).otherwise(0.0) + F.when(temporal_f1 > 0.6, 0.15).when(temporal_f1 > 0.4, 0.05).otherwise(0.0)


def chunk_id(uid: Column, source: Column, position: Column) -> Column:
    """The uid, or source (doc if null) and position joined by a colon."""
    return F.coalesce(null_if_blank(uid), F.concat_ws(":", F.coalesce(source, F.lit("doc")), position.cast("string")))


def cited_context(chunks: DataFrame) -> DataFrame:
    """(query_id, context) of (query_id, rank, source, text): '[n] (source) text' by rank, a blank line between."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), F.coalesce("source", F.lit("unknown")), F.lit(") "), F.col("text"))
    x = chunks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("xs"))
    return x.select("query_id", F.array_join(F.transform("xs", lambda r: r["line"]), "\n\n").alias("context"))


def graph_errors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(error, n): nodes without id, edges without source or target, edges with unknown ends; only those that occur."""
    known = nodes.select(F.col("id").alias("x")).filter("x IS NOT NULL").distinct()
    lost = edges.select(F.explode(F.array("source", "target")).alias("x")).filter("x IS NOT NULL").join(known, "x", "left_anti")
    rows = [(nodes.filter("id IS NULL"), "node without id"), (edges.filter("source IS NULL"), "edge without source"), (edges.filter("target IS NULL"), "edge without target"), (lost, "unknown end")]
    out = None
    for df, name in rows:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("error"), "n")
        out = one if out is None else out.unionByName(one)
    return out.filter("n > 0")


def ego_graphs(edges: DataFrame, seeds: DataFrame, hops: int = 2, cap: int = 1000, least: float = 0.5) -> DataFrame:
    """(seed, node, hop, degree): nodes within ``hops`` of each seed over edges (u, v, confidence) from ``least`` on.

    The first ``cap`` by hop and node stay, the seed as hop 0; degree counts distinct neighbours among them.
    """
    e = edges.filter(F.col("confidence") >= least).select("u", "v").filter("u <> v")
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    seen = frontier = seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        step = frontier.join(both, F.col("node") == F.col("u")).select("seed", F.col("v").alias("node")).distinct()
        frontier = step.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("hop", "node"))
    kept = seen.withColumn("r", rank).filter(F.col("r") <= cap).select("seed", "node", "hop")
    inside = kept.join(both, F.col("node") == F.col("u")).select("seed", F.col("u").alias("node"), F.col("v").alias("nbr"))
    degree = inside.join(kept.select("seed", F.col("node").alias("nbr")), ["seed", "nbr"], "left_semi").groupBy("seed", "node").agg(F.count(F.lit(1)).alias("degree"))
    return kept.join(degree, ["seed", "node"], "left").select("seed", "node", "hop", F.coalesce("degree", F.lit(0)).alias("degree"))
