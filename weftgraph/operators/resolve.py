"""Entity resolution: evidence that two entities are one, clusters, and rows rewritten to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_tight, fold_words, levenshtein_similarity
from .graph import components


def shared_key_edges(rows: DataFrame, *key: str) -> DataFrame:
    """(a, b) from each id to the smallest id with the same key; linear in the rows, however large a key."""
    low = rows.groupBy(*key).agg(F.min("id").alias("b"))
    return rows.join(low, list(key)).filter("id <> b").select(F.col("id").alias("a"), "b")


def fuzzy_edges(entities: DataFrame, threshold: float = 0.9, prefix: int = 1) -> DataFrame:
    """(a, b, similarity): names alike in edit distance, within blocks of type and first letters.

    Equal folded names are compared once. A pair whose lengths rule the threshold out is
    dropped before the distance is computed. Callers resolve exact matches first.
    """
    names = entities.select("type", fold_tight(F.col("name")).alias("folded"), "id").filter("folded <> ''").groupBy("type", "folded").agg(F.min("id").alias("id"))
    block = names.withColumn("block", F.substring("folded", 1, prefix)).withColumn("n", F.length("folded"))
    a, b = block.alias("a"), block.alias("b")
    near = (F.col("a.type") == F.col("b.type")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id"))
    bound = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
    pairs = a.join(b, near).filter(bound).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), levenshtein_similarity(F.col("a.folded"), F.col("b.folded")).alias("similarity"))
    return pairs.filter(F.col("similarity") >= threshold)


def resolve(entities: DataFrame, threshold: float = 0.9, prefix: int = 1) -> DataFrame:
    """(id, cluster) of (id, type, name, synonyms, xref): entities that are one share the smallest id.

    They share an identifier, a folded name within a type, a synonym within a type, or a
    similar name within a block; the relation is closed transitively.
    """
    named = entities.select("id", "type", fold_tight(F.col("name")).alias("k")).filter("k <> ''")
    terms = entities.select("id", "type", F.explode(F.concat(F.array("name"), "synonyms")).alias("s")).select("id", "type", fold_tight(F.col("s")).alias("k")).filter("k <> ''").distinct()
    edges = shared_key_edges(entities.filter("xref IS NOT NULL").select("id", "xref"), "xref")
    edges = edges.unionByName(shared_key_edges(named, "type", "k")).unionByName(shared_key_edges(terms, "type", "k")).unionByName(fuzzy_edges(entities, threshold, prefix).select("a", "b"))
    roots = components(edges).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    return entities.select("id").join(roots, "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster"))


def collapse(entities: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: the entity with an identifier, most synonyms, then smallest id; surfaces united."""
    x = entities.join(clusters, "id").withColumn("order", F.struct(F.col("xref").isNull().alias("x"), (-F.size("synonyms")).alias("s"), F.col("id")))
    surface = F.concat(F.array("name"), "synonyms")
    each = x.select("cluster", F.explode(surface).alias("s")).filter("s IS NOT NULL").distinct().groupBy("cluster").agg(F.sort_array(F.collect_list("s")).alias("surfaces"))
    top = x.groupBy("cluster").agg(F.min_by(F.struct("id", "name", "type"), "order").alias("p"), F.min("xref").alias("xref"), F.count(F.lit(1)).alias("members"))
    return top.join(each, "cluster").select("cluster", F.col("p.id").alias("id"), F.col("p.name").alias("name"), F.col("p.type").alias("type"), "xref", "members", "surfaces")


def repoint(relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Relations between clusters; those that become self-relations go, and repeats are one."""
    s, o = clusters.select(F.col("id").alias("subject"), F.col("cluster").alias("cs")), clusters.select(F.col("id").alias("object"), F.col("cluster").alias("co"))
    x = relations.join(s, "subject", "left").join(o, "object", "left")
    return x.select(F.coalesce("cs", "subject").alias("subject"), "predicate", F.coalesce("co", "object").alias("object")).filter("subject <> object").distinct()


def resolve_mentions(mentions: DataFrame) -> DataFrame:
    """Nodes of (doc_id, text, label, confidence): one per label and folded text.

    The canonical text is the most frequent surface, then the shortest, then the first.
    node_id numbers the keys of a label by a hash-free rank of their folded text.
    """
    x = mentions.select("doc_id", "text", F.upper("label").alias("label"), fold_words(F.col("text")).alias("folded"), "confidence").filter("folded <> ''")
    surface = x.groupBy("label", "folded", "text").agg(F.count(F.lit(1)).alias("n"))
    best = surface.groupBy("label", "folded").agg(F.min_by("text", F.struct((-F.col("n")).alias("n"), F.length("text"), F.col("text"))).alias("canonical"), F.count(F.lit(1)).alias("n_surfaces"))
    sums = x.groupBy("label", "folded").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("doc_id").alias("documents"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.max("confidence").alias("max_confidence"))
    key = F.concat_ws("_", F.lower("label"), F.substring(F.md5(F.concat_ws("|", "label", "folded")), 1, 12))
    return sums.join(best, ["label", "folded"]).withColumn("node_id", key)


def aggregate_edges(edges: DataFrame, keys: list[str], first: list[str], order: str) -> DataFrame:
    """Counts and largest confidence per key; the ``first`` columns are those of the first row by ``order``."""
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("mentions"), F.max("confidence").alias("confidence"), *[F.min_by(c, order).alias(c) for c in first])
