"""Parquet tables, and the dated graph that the driver's tables stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First year of the test period in the stand-in graph.
CUTOFF = 1999


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """The frame itself; raises naming the columns that are missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def main_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's costliest line with its customer and date, from whole tables: (o_custkey, o_orderdate, m)."""
    lines = table(spark, folder, "lineitem")
    top = F.max(F.struct("l_extendedprice", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount", "l_linestatus")).alias("m")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.groupBy("l_orderkey").agg(top).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def assertions(spark: SparkSession, folder: str) -> DataFrame:
    """Dated assertions customer - part, one an order: (subject, object, year, predicate, confidence, negated)."""
    return main_lines(spark, folder).select(
        F.concat(F.lit("C:"), "o_custkey").alias("subject"),
        F.concat(F.lit("P:"), "m.l_partkey").alias("object"),
        F.year("o_orderdate").alias("year"),
        F.col("m.l_returnflag").alias("predicate"),
        (1 - F.col("m.l_discount")).alias("confidence"),
        (F.col("m.l_linestatus") == "O").alias("negated"),
    )


def backbone(spark: SparkSession, folder: str) -> DataFrame:
    """Undated edges part - supplier, each part's most frequent one: (u, v)."""
    n = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("l_partkey").agg(F.max(F.struct("n", "l_suppkey")).alias("m"))
    return top.select(F.concat(F.lit("P:"), "l_partkey").alias("u"), F.concat(F.lit("S:"), "m.l_suppkey").alias("v"))
