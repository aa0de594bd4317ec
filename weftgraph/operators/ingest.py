"""Curated sources as property-graph rows: ids, evidence, profiles, enrichment, ontologies, interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold_words, null_if_blank, strip_float_suffix

#: Confidence by evidence level.
LEVELS = {"A": 0.95, "B": 0.80, "C": 0.60, "D": 0.45, "E": 0.30}

#: Fixed values: (evidence type, significance) to (predicate, kind of object).
PREDICATES = {
    ("Predictive", "Sensitivity/Response"): ("SENSITIZES_TO", "therapy"),
    ("Predictive", "Resistance"): ("RESISTANT_TO", "therapy"),
    ("Predictive", "Reduced Sensitivity"): ("RESISTANT_TO", "therapy"),
    ("Predictive", "Adverse Response"): ("RESISTANT_TO", "therapy"),
    ("Prognostic", "Poor Outcome"): ("PREDICTS_POOR_OUTCOME", "disease"),
    ("Prognostic", "Better Outcome"): ("PREDICTS_BETTER_OUTCOME", "disease"),
    ("Diagnostic", "Positive"): ("DIAGNOSTIC_FOR", "disease"),
    ("Diagnostic", "Negative"): ("EXCLUDES_DIAGNOSIS", "disease"),
    ("Predisposing", "Predisposition"): ("PREDISPOSES_TO", "disease"),
    ("Oncogenic", "Oncogenicity"): ("CAUSES", "disease"),
}


def gene_id(entrez: Column, symbol: Column) -> Column:
    """GENE:entrez if it has one other than 0, else GENE:SYMBOL."""
    number = strip_float_suffix(F.trim(null_if_blank(entrez)))
    return F.concat_ws(":", F.lit("GENE"), F.coalesce(F.when(number != "0", number), F.upper(F.trim(symbol))))


def named_id(prefix: str, name: Column, number: Column | None = None) -> Column:
    """PREFIX:number, or PREFIX:NAME where there is no number."""
    by_name = F.upper(F.trim(name))
    return F.concat_ws(":", F.lit(prefix), by_name if number is None else F.coalesce(strip_float_suffix(F.trim(null_if_blank(number))), by_name))


def values(cell: Column) -> Column:
    """A comma-packed cell as an array, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin("", "nan"))


def confidence(level: Column, rating: Column) -> Column:
    """Level confidence, times 0.85 + 0.06 * rating if rated, at most 1; not rounded."""
    base = None
    for k, v in LEVELS.items():
        base = F.when(level == k, v) if base is None else base.when(level == k, v)
    base = base.otherwise(0.5)
    return F.least(F.lit(1.0), F.when(rating.isNotNull(), base * (0.85 + 0.06 * rating)).otherwise(base))


def predicate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*k, *v) for k, v in PREDICATES.items()], "evidence_type string, significance string, predicate string, target string")


def resolve_profiles(evidence: DataFrame, variants: DataFrame) -> DataFrame:
    """(evidence_id, variant_id) of each profile: a whole-name hit, else its resolvable parts at AND and OR.

    Names are compared in upper case; of variants alike in name the smallest id counts.
    """
    index = variants.groupBy(F.upper(F.trim("name")).alias("key")).agg(F.min("variant_id").alias("variant_id"))
    keyed = evidence.select("evidence_id", F.upper(F.trim("profile")).alias("whole"))
    hit = keyed.join(index, F.col("whole") == F.col("key"), "left").select("evidence_id", "whole", "variant_id")
    part = hit.filter("variant_id IS NULL").select("evidence_id", F.explode(F.split("whole", "\\s+(?:AND|OR)\\s+")).alias("part"))
    parts = part.join(index, F.trim("part") == F.col("key")).select("evidence_id", "variant_id").distinct()
    return hit.filter("variant_id IS NOT NULL").select("evidence_id", "variant_id").unionByName(parts)


def fan_out(evidence: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, negated) relations of (evidence_id, subject, kind, predicate, disease, therapies, phenotypes, direction).

    Therapy-kind evidence links the subject to each therapy; the subject is linked to the
    disease, ASSOCIATED_WITH for therapy kind with therapies; to each phenotype PRESENTS_WITH;
    and each therapy TREATS the disease. Relations alike in id are one.
    """
    base = evidence.withColumn("negated", F.coalesce(F.col("direction") == "Does Not Support", F.lit(False))).withColumn("is_therapy", (F.col("kind") == "therapy") & (F.size("therapies") > 0))
    row = lambda df, s, p, o: df.select(F.concat_ws(":", "evidence_id", p, s, o).alias("id"), s.alias("subject"), p.alias("predicate"), o.alias("object"), "negated")
    each = base.withColumn("t", F.explode("therapies"))
    out = [
        row(each.filter("is_therapy"), F.col("subject"), F.col("predicate"), F.col("t")),
        row(base.filter("disease IS NOT NULL"), F.col("subject"), F.when(F.col("is_therapy"), "ASSOCIATED_WITH").otherwise(F.col("predicate")), F.col("disease")),
        row(base.withColumn("p", F.explode("phenotypes")), F.col("subject"), F.lit("PRESENTS_WITH"), F.col("p")),
        row(each.filter("disease IS NOT NULL"), F.col("t"), F.lit("TREATS"), F.col("disease")),
    ]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.dropDuplicates(["id"])


def enrichment(mutations: DataFrame, genes: DataFrame, cohorts: DataFrame) -> DataFrame:
    """(symbol, project, occurrences, cases, expected, enrichment) against a length-proportional background.

    A cohort's total counts genes with a positive length; expected = total * length / sum of
    all lengths. Genes without length and cohorts without cases are left out.
    """
    usable = genes.filter("length > 0")
    total = usable.agg(F.sum("length").alias("all_length"))
    x = mutations.join(usable, "symbol").join(cohorts.filter("cases > 0"), "project")
    sums = x.groupBy("project").agg(F.sum("occurrences").alias("cohort_total"))
    x = x.join(sums, "project").join(F.broadcast(total))
    expected = F.col("cohort_total") * F.col("length") / F.col("all_length")
    return x.select("symbol", "project", "occurrences", "cases", expected.alias("expected"), F.when(expected > 0, F.col("occurrences") / expected).otherwise(0.0).alias("enrichment"))


def match_by_ancestor(terms: DataFrame, closure: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, target, step): the term itself if it is a target, else its nearest ancestor that is; ties by target."""
    own = terms.select("term", F.col("term").alias("target"), F.lit(0).alias("step"))
    up = terms.join(closure, F.col("term") == F.col("child")).select("term", F.col("ancestor").alias("target"), "step")
    hit = own.unionByName(up).join(targets.select("target"), "target", "left_semi")
    best = hit.groupBy("term").agg(F.min(F.struct("step", "target")).alias("b"))
    return terms.join(best, "term", "left").select("term", F.col("b.target").alias("target"), F.col("b.step").alias("step"))


#: Channels that rest on literature or other databases; refused unless allowed.
LITERATURE_CHANNELS = ("textmining", "database")


def interactions(links: DataFrame, channels: tuple[str, ...], known: tuple[str, ...], least: int = 400, allow_literature: bool = False) -> DataFrame:
    """(a, b, score, channel): best channel score of each canonical pair of (a, b, channel columns), from ``least`` on."""
    if unknown := [c for c in channels if c not in known]:
        raise ValueError(f"unknown channels: {unknown}")
    if not allow_literature and (refused := [c for c in channels if c in LITERATURE_CHANNELS]):
        raise ValueError(f"literature channels need allow_literature: {refused}")
    best = F.greatest(*[F.col(c) for c in channels]) if len(channels) > 1 else F.col(channels[0])
    name = F.coalesce(*[F.when(F.col(c) == best, c) for c in channels])
    x = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), best.alias("score"), name.alias("channel")).filter(F.col("score") >= least)
    top = x.groupBy("a", "b").agg(F.max_by(F.struct("score", "channel"), F.struct("score", "channel")).alias("m"))
    return top.select("a", "b", "m.score", "m.channel")


def channel_report(links: DataFrame, channels: tuple[str, ...], least: int = 400) -> DataFrame:
    """(channel, edges): canonical pairs whose score in the channel reaches ``least``."""
    pairs = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("score")) for c in channels])).alias("x"))
    return pairs.filter(F.col("x.score") >= least).select("a", "b", "x.channel").distinct().groupBy("channel").agg(F.count(F.lit(1)).alias("edges"))


def surfaces(terms: DataFrame) -> DataFrame:
    """(surface, id): names before synonyms, then by ontology and id, one id a folded surface."""
    x = terms.select("id", "ontology", F.explode(F.concat(F.array(F.struct(F.col("name").alias("s"), F.lit(0).alias("rank"))), F.transform("synonyms", lambda y: F.struct(y.alias("s"), F.lit(1).alias("rank"))))).alias("x"))
    keyed = x.select(fold_words(F.col("x.s")).alias("surface"), F.struct(F.col("x.rank"), F.col("ontology"), F.col("id")).alias("order"), "id").filter("surface <> ''")
    return keyed.groupBy("surface").agg(F.min_by("id", "order").alias("id"))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
