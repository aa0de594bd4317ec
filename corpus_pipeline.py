"""From raw documents to a training mix: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. ``run`` writes each stage's rows to the shared checkpoint folder
and reads them again, so that no stage is computed twice and a lost executor costs tasks,
not stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, line_dedup, mixing, ngram_join, toxicity
from weftgraph.llm.shared import ship, stored

#: SQL can't express the classifier, the n-gram join or the templates; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


#: A name that no column of documents has.
KEY = "__weft_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows alike in id and text share a key, so rows without an id can be told apart."""
    return docs.withColumn(KEY, F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, scores below 0.3; null texts stay."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.filter((F.col("score") < 0.3) | F.col("text").isNull()).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of runs of lines; a document that was all copies goes. n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", "\\s+", " ")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id (null last), then hash; of rows alike in both, the first by all columns."""
    ship(spark)
    keyed = _keyed(docs)
    ids = ngram_join.ngram_join(keyed.select("doc_id", "text", KEY), key=KEY)
    ids = stored(ids.filter("n_links > 0").select(KEY, "group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(KEY).alias("key")).alias("order")))
    rest = keyed.join(ids.select(KEY).distinct(), KEY, "left_anti")
    first = ids.groupBy("group").agg(F.min("order").alias("order")).select(F.col("order.key").alias(KEY))
    first = keyed.join(first, KEY, "left_semi").groupBy(KEY).agg(F.min(F.struct(*docs.columns)).alias("row")).select(KEY, "row.*")
    return rest.unionByName(first).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark, as it stands or re-parameterised."""
    ship(spark)
    keyed = _keyed(docs)
    hits = decontamination.decontaminate(keyed.select(F.col(KEY).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hits = stored(hits.select(F.col("doc_id").alias(KEY)).distinct())
    return keyed.join(hits, KEY, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each remaining document that bring the sources to their target weights; ids and counts, no text."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Returns what mixing returns: one row a document kept, with its copies but without its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
