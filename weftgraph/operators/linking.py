"""Mentions linked to entities: similar names by rare bigrams, compatible types, disambiguation, link kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import levenshtein_similarity

#: Types that are nearly the same as a mention's.
COMPATIBLE = {
    "GENE": ("PROTEIN", "GENE_PRODUCT"),
    "PROTEIN": ("GENE", "GENE_PRODUCT"),
    "DISEASE": ("DISORDER", "CONDITION"),
    "DRUG": ("COMPOUND", "CHEMICAL", "MEDICATION"),
    "CHEMICAL": ("DRUG", "COMPOUND"),
    "MUTATION": ("VARIANT", "ALTERATION"),
}

#: Other types that a mention's candidates are looked for in.
SEARCHED = {"GENE": ("PROTEIN",), "PROTEIN": ("GENE",), "DISEASE": ("DISORDER",), "DRUG": ("CHEMICAL", "COMPOUND"), "CHEMICAL": ("DRUG",)}


def normalised_name(c: Column) -> Column:
    """Lower case, white space collapsed, signs but hyphens dropped, then the words gene and protein; spaces left by those stay."""
    spaced = F.regexp_replace(F.lower(F.trim(c)), "\\s+", " ")
    plain = F.regexp_replace(spaced, "[^\\p{L}\\p{N}_\\s-]", "")
    return F.trim(F.regexp_replace(plain, "\\b(gene|protein)\\b", ""))


def type_compatibility(mention: Column, entity: Column) -> Column:
    """1 for equal types, 0.8 for compatible ones, else 0; any case."""
    a, b = F.upper(mention), F.upper(entity)
    out = F.when(a == b, 1.0)
    for kind, others in COMPATIBLE.items():
        out = out.when((a == kind) & b.isin(*others), 0.8)
    return out.otherwise(0.0)


def similar_names(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of names (a) and (b) whose Levenshtein similarity is ``threshold`` or more, 0.75 at least.

    Strings within d edits share all but 2 d of their numbered bigrams, so they share one among
    the 2 d + 1 rarest of each; those meet in an equi-join and the distance is then computed.
    Equal names meet by themselves. No block of names is compared pairwise.
    """
    if threshold < 0.75:
        raise ValueError("below 0.75 similar names need not share a bigram")
    a, b = left.select("a").filter("a IS NOT NULL").distinct(), right.select("b").filter("b IS NOT NULL").distinct()
    same = a.join(b, F.col("a") == F.col("b")).select("a", "b", F.lit(1.0).alias("similarity"))

    def grams(df: DataFrame, c: str) -> DataFrame:
        pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(F.col(c), i, F.lit(2)))
        x = df.filter(F.length(c) > 1).select(c, F.explode(pairs).alias("g"))
        return x.groupBy(c, "g").agg(F.count(F.lit(1)).alias("n")).select(c, "g", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))

    ga, gb = grams(a, "a"), grams(b, "b")
    often = ga.select("g", "k").unionByName(gb.select("g", "k")).groupBy("g", "k").agg(F.count(F.lit(1)).alias("often"))

    def rarest(g: DataFrame, c: str) -> DataFrame:
        edits = F.floor((1 - threshold) * F.length(c) / threshold + 1e-9)
        rank = F.row_number().over(Window.partitionBy(c).orderBy("often", "g", "k"))
        return g.join(often, ["g", "k"]).withColumn("r", rank).filter(F.col("r") <= 2 * edits + 1).select(c, "g", "k")

    met = rarest(ga, "a").join(rarest(gb, "b"), ["g", "k"]).select("a", "b").distinct().filter("a <> b")
    bound = F.least(F.length("a"), F.length("b")) >= (threshold - 1e-9) * F.greatest(F.length("a"), F.length("b"))
    near = met.filter(bound).select("a", "b", levenshtein_similarity(F.col("a"), F.col("b")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-9)
    return same.unionByName(near)


def best_matches(queries: DataFrame, candidates: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(query_id, rank, candidate, score): the ``k`` candidates of every query (query_id, text) most like it, from ``threshold`` on, ties by name."""
    q = queries.select("query_id", normalised_name(F.col("text")).alias("a"))
    c = candidates.select("candidate", normalised_name(F.col("candidate")).alias("b")).distinct()
    hit = q.join(similar_names(q, c, threshold), "a").join(c, "b").select("query_id", "candidate", F.col("similarity").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate"))
    return hit.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "candidate", "score")


def link_names(mentions: DataFrame, candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(query_id, kg_id, confidence, match_type): the best match of every mention; exact at 1, fuzzy, or unmatched with null and 0."""
    best = best_matches(mentions, candidates, 1, threshold)
    x = mentions.select("query_id").join(best, "query_id", "left")
    kind = F.when(F.col("score").isNull(), "unmatched").when(F.col("score") >= 1, "exact").otherwise("fuzzy")
    return x.select("query_id", F.col("candidate").alias("kg_id"), F.coalesce("score", F.lit(0.0)).alias("confidence"), kind.alias("match_type"))


def candidate_entities(mentions: DataFrame, entities: DataFrame, threshold: float = 0.85, semantic: DataFrame | None = None) -> DataFrame:
    """(mention_id, entity_id, similarity) of mentions (mention_id, text, label) and entities (entity_id, type, name, synonyms).

    Types are the mention's or those searched with it. The similarity is that of the nearest of
    name and synonyms, times 0.8 + 0.2 * type compatibility. Scores of ``semantic`` (mention_id,
    entity_id, score) from 0.6 on count for mentions whose best is below 0.9, if they are higher.
    """
    wanted = [(k, k) for k in SEARCHED] + [(k, t) for k, ts in SEARCHED.items() for t in ts]
    types = F.broadcast(mentions.sparkSession.createDataFrame(wanted, "label string, type string"))
    m = mentions.select("mention_id", F.upper("label").alias("label"), normalised_name(F.col("text")).alias("a"))
    other = m.select("label").distinct().join(types.select("label").distinct(), "label", "left_anti").select("label", F.col("label").alias("type"))
    types = types.unionByName(other)
    s = entities.select("entity_id", F.upper("type").alias("type"), F.explode(F.concat(F.array("name"), "synonyms")).alias("s")).select("entity_id", "type", normalised_name(F.col("s")).alias("b"))
    near = similar_names(m, s, threshold)
    hit = m.join(types, "label").join(near, "a").join(s, ["b", "type"])
    score = F.col("similarity") * (0.8 + 0.2 * type_compatibility(F.col("label"), F.col("type")))
    found = hit.groupBy("mention_id", "entity_id").agg(F.max(score).alias("similarity"))
    if semantic is None:
        return found
    best = found.groupBy("mention_id").agg(F.max("similarity").alias("best"))
    weak = semantic.filter("score >= 0.6").join(best, "mention_id", "left").filter("best IS NULL OR best < 0.9").select("mention_id", "entity_id", F.col("score").alias("similarity"))
    return found.unionByName(weak).groupBy("mention_id", "entity_id").agg(F.max("similarity").alias("similarity"))


def disambiguate(candidates: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(mention_id, entity_id, confidence, match_type) of (mention_id, entity_id, similarity, context).

    A mention's only candidate is taken: EXACT at 1, FUZZY from 0.9 on, else SEMANTIC. Of several
    the best by 0.6 * similarity + 0.4 * context is taken as CONTEXTUAL, with the mean of both as
    confidence, if it reaches ``threshold``; else the mention is a CONFLICT without entity. Ties by id.
    """
    score = 0.6 * F.col("similarity") + 0.4 * F.col("context")
    order = F.struct((-score).alias("s"), (-F.col("similarity")).alias("t"), "entity_id")
    x = candidates.withColumn("score", score).groupBy("mention_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("entity_id", "similarity", "context", "score"), order).alias("b"))
    one, good = F.col("n") == 1, F.col("b.score") >= threshold
    kind = F.when(one & (F.col("b.similarity") >= 1), "EXACT").when(one & (F.col("b.similarity") >= 0.9), "FUZZY").when(one, "SEMANTIC").when(good, "CONTEXTUAL").otherwise("CONFLICT")
    taken = one | good
    confidence = F.when(one, F.col("b.similarity")).when(good, (F.col("b.similarity") + F.col("b.context")) / 2).otherwise(0.0)
    return x.select("mention_id", F.when(taken, F.col("b.entity_id")).alias("entity_id"), confidence.alias("confidence"), kind.alias("match_type"))


def link_statistics(links: DataFrame) -> DataFrame:
    """(match_type, bin, links) with subtotals, '*' and -1 standing for all; bins are tenths of the confidence, cut off."""
    binned = links.withColumn("bin", F.floor(F.col("confidence") * 10 + 1e-9) / 10)
    cube = binned.rollup("match_type", "bin").agg(F.count(F.lit(1)).alias("links"))
    return cube.select(F.coalesce("match_type", F.lit("*")).alias("match_type"), F.coalesce("bin", F.lit(-1.0)).alias("bin"), "links")
