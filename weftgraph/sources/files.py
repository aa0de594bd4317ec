"""Curated files as frames: TSV tables, gzip link files, OBO ontologies, JSON graphs, documents and caches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_words, null_if_blank, strip_float_suffix
from ..operators import ingest
from .tables import require_columns

#: Columns that each curated table must have.
REQUIRED = {
    "evidence": ("evidence_id", "molecular_profile", "disease", "therapies", "evidence_type", "significance", "evidence_level", "citation"),
    "variants": ("variant_id", "variant", "gene"),
    "features": ("name", "entrez_id"),
}


def read_tsv(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A tab-separated table with a header, all columns strings, blanks and 'nan' null; raises on missing columns."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    require_columns(df, *REQUIRED.get(kind, ()))
    return df.select(*[null_if_blank(F.col(f"`{c}`")).alias(c) for c in df.columns])


#: Declared feature types and their node types.
FEATURE_TYPES = {"Gene": "GENE", "Fusion": "FUSION", "Factor": "FACTOR", "Region": "REGION"}


def features(df: DataFrame) -> DataFrame:
    """(id, name, type) of a feature table; rows without a symbol go, unknown types are genes."""
    for c in ("gene", "feature_type"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    symbol = F.coalesce("name", "gene")
    kind = F.coalesce(*[F.when(F.col("feature_type") == k, v) for k, v in FEATURE_TYPES.items()], F.lit("GENE"))
    return df.filter(symbol.isNotNull()).select(ingest.gene_id(F.col("entrez_id"), symbol).alias("id"), F.trim(symbol).alias("name"), kind.alias("type"))


def variants(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Variant entities (id, name, type), and HAS_VARIANT edges from their genes with confidence 1."""
    if "entrez_id" not in df.columns:
        df = df.withColumn("entrez_id", F.lit(None).cast("string"))
    x = df.filter("variant_id IS NOT NULL").withColumn("id", F.concat(F.lit("MUTATION:"), strip_float_suffix(F.col("variant_id"))))
    edges = x.filter("gene IS NOT NULL").select(ingest.gene_id(F.col("entrez_id"), F.col("gene")).alias("subject"), F.lit("HAS_VARIANT").alias("predicate"), F.col("id").alias("object"), F.lit(1.0).alias("confidence"))
    return x.select("id", F.concat_ws(" ", "gene", "variant").alias("name"), F.lit("MUTATION").alias("type")), edges


#: Accepted header spellings of protein info files.
ID_NAMES, SYMBOL_NAMES = ("#string_protein_id", "string_protein_id"), ("preferred_name", "protein_name")


def protein_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(protein, symbol) of a gzip or plain protein info table, by header name."""
    df = spark.read.csv(path, sep="\t", header=True)
    pick = lambda names: next((c for c in names if c in df.columns), None)
    i, s = pick(ID_NAMES), pick(SYMBOL_NAMES)
    if i is None or s is None:
        raise ValueError(f"no id or symbol column among {df.columns}")
    return df.select(F.col(f"`{i}`").alias("protein"), F.col(s).alias("symbol"))


def protein_links(spark: SparkSession, path: str, symbols: DataFrame, channels: tuple[str, ...], keep: DataFrame | None = None, least: int = 400, allow_literature: bool = False) -> DataFrame:
    """Best interactions of a space-delimited link file, by symbol; see operators.ingest.interactions."""
    df = spark.read.csv(path, sep=" ", header=True)
    require_columns(df, *channels)
    x = df.select("protein1", "protein2", *[F.col(c).cast("int").alias(c) for c in channels])
    x = x.join(symbols.select(F.col("protein").alias("protein1"), F.col("symbol").alias("a")), "protein1").join(symbols.select(F.col("protein").alias("protein2"), F.col("symbol").alias("b")), "protein2")
    if keep is not None:
        x = x.join(keep.select(F.col("symbol").alias("a")), "a", "left_semi").join(keep.select(F.col("symbol").alias("b")), "b", "left_semi")
    known = tuple(c for c in df.columns if c not in ("protein1", "protein2"))
    return ingest.interactions(x, channels, known, least, allow_literature)


def ontology_terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, synonyms, parents) of the [Term] stanzas of an OBO file; other stanzas are skipped."""
    raw = spark.read.text(path, lineSep="\n[").select(F.col("value").alias("t")).filter(F.col("t").rlike("^\\[?Term\\]"))
    one = lambda tag: F.regexp_extract("t", f"(?m)^{tag}: *(.+?) *$", 1)
    many = lambda pattern: F.regexp_extract_all("t", F.lit(pattern), 1)
    x = raw.select(one("id").alias("id"), one("name").alias("name"), many('(?m)^synonym: *"([^"]*)"').alias("synonyms"), many("(?m)^is_a: *([^ !\\n]+)").alias("parents"), F.col("t").rlike("(?m)^is_obsolete: *true").alias("old"))
    return x.filter("id <> '' AND NOT old").drop("old")


def is_a(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("id").alias("child"), F.explode("parents").alias("parent"))


def surface_index(terms: DataFrame) -> DataFrame:
    """(surface, id) of folded names and synonyms; names come first, then the smaller id."""
    x = terms.select("id", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("r"), F.col("name").alias("s"))), F.transform("synonyms", lambda s: F.struct(F.lit(1).alias("r"), s.alias("s"))))).alias("x"))
    return x.select(fold_words(F.col("x.s")).alias("surface"), F.struct(F.col("x.r"), F.col("id")).alias("o")).filter("surface <> ''").groupBy("surface").agg(F.min("o").alias("o")).select("surface", F.col("o.id").alias("id"))


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name) and edges (source, target, relation) of a JSON graph with any of the usual field names.

    Ends may be named source, src or from and target, dst or to; edges that lack one go.
    """
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    get = lambda c, *names: F.coalesce(*[F.try_variant_get(c, f"$.{n}", "string") for n in names])
    item = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in names])
    nodes = raw.select(F.explode(item("nodes", "entities")).alias("n")).select(F.coalesce(get("n", "id", "name"), F.lit("node")).alias("id"), get("n", "name", "id").alias("name"))
    edges = raw.select(F.explode(item("edges", "links", "relations")).alias("e")).select(get("e", "source", "src", "from", "subject").alias("source"), get("e", "target", "dst", "to", "object").alias("target"), F.coalesce(get("e", "relation", "predicate", "type"), F.lit("RELATED_TO")).alias("relation"))
    return nodes, edges.dropna(subset=["source", "target"])


def documents_json(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, title, abstract) of a JSON list, or of an object's documents, results or articles."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    list_ = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *[F.try_variant_get("v", f"$.{n}", "array<variant>") for n in ("documents", "results", "articles")])
    return raw.select(F.explode(list_).alias("d")).select(*[F.try_variant_get("d", f"$.{c}", "string").alias(c) for c in ("pmid", "title", "abstract")])


def valid_documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a title or an abstract, and the rest for quarantine."""
    good = F.coalesce(null_if_blank(F.col("title")), null_if_blank(F.col("abstract"))).isNotNull()
    return df.filter(good), df.filter(~good)


def facet_counts(spark: SparkSession, path: str, limit: int = 200) -> DataFrame:
    """(symbol, project, occurrences) of {symbol: {project: n}}; raises where a symbol's buckets reach the service's limit.

    The bucket for missing projects is dropped.
    """
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, map<string, bigint>>")).alias("symbol", "m"))
    full = F.size("m") >= limit
    m = F.when(full, F.raise_error(F.concat(F.lit("truncated facets of "), F.col("symbol")))).otherwise(F.col("m"))
    return raw.select("symbol", F.explode(m).alias("project", "occurrences")).filter("project <> '_missing'")


def write_graph(entities: DataFrame, relations: DataFrame, path: str) -> dict:
    """Entities, relations and their statistics under a folder; returns the statistics."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")
    relations.write.mode("overwrite").parquet(f"{path}/relations")
    spark = entities.sparkSession
    by = spark.read.parquet(f"{path}/relations").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))
    by.write.mode("overwrite").json(f"{path}/statistics")
    return {"entities": spark.read.parquet(f"{path}/entities").count(), "relations": {r["predicate"]: r["n"] for r in by.collect()}}


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/entities"), spark.read.parquet(f"{path}/relations")


def write_cache(df: DataFrame, path: str, release: str, program: str) -> None:
    """A cache partitioned by release and program, so that another release is never read."""
    df.withColumns({"release": F.lit(release), "program": F.lit(program)}).write.mode("append").partitionBy("release", "program").parquet(path)


def read_cache(spark: SparkSession, path: str, release: str, program: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("release") == release) & (F.col("program") == program)).drop("release", "program")


def format_report(df: DataFrame, limit: int = 50) -> str:
    """A small frame as a fixed-width table; at most ``limit`` rows."""
    rows = [list(map(str, df.columns))] + [[str(v) for v in r] for r in df.limit(limit).collect()]
    widths = [max(len(r[i]) for r in rows) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def report_json(df: DataFrame, limit: int = 1000) -> str:
    """A report's rows as JSON; a frame of more than ``limit`` rows is no report and raises."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows; write the frame as a table")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str)
