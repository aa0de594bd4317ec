"""Reproducible sampling: every draw is a hash of seed and row, so it doesn't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.session import checkpointed, release
from .graph import degrees, numbered


def draw(*parts: Column | str) -> Column:
    """A 32-bit number from the md5 of the parts joined by '|'; the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def degree_bucket(deg: Column) -> Column:
    """floor(log2 d) + 1 for d > 0, else 0, from the binary digits of d."""
    return F.when(deg > 0, F.length(F.bin(deg.cast("long")))).otherwise(0)


def negatives(positives: DataFrame, adj: DataFrame, known: DataFrame, node_type, per_positive: int = 1, seed: int = 0, attempts: int = 4, degree_matched: bool = False) -> DataFrame:
    """(u, v): unknown pairs whose endpoints come from the pools of a positive's endpoints.

    A pool is a node type, and a degree bucket if degrees are matched. For each positive,
    attempts * per_positive pairs are drawn; self-pairs, known pairs and repeats go, and the
    first per_positive of the rest stay. A repeated pair belongs to its first draw.
    """
    deg = degrees(adj)
    bucket = degree_bucket(F.col("deg")).cast("string") if degree_matched else F.lit("-")
    nodes = deg.select("node", F.concat_ws("/", node_type("node"), bucket).alias("pool"))
    pools = checkpointed(numbered(nodes, "pool", "node").select("pool", "node", "index", "pool_size"))
    side = lambda c: pools.select(F.col("node").alias(c), F.col("pool").alias(f"pool_{c}"), F.col("pool_size").alias(f"size_{c}"))
    # a positive is carried as its number in the order of (u, v)
    wanted = checkpointed(positives.select("u", "v").distinct().orderBy("u", "v").withColumn("p", F.monotonically_increasing_id()))
    release(wanted.sparkSession)
    tries = wanted.join(side("u"), "u").join(side("v"), "v").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(attempts * per_positive - 1))))
    s, j = F.lit(str(seed)), F.col("j").cast("string")
    index = lambda c, end: (draw(s, "u", "v", j, F.lit(end)) % F.col(f"size_{c}")).alias(f"i{end}")
    tries = tries.select("p", "j", "pool_u", "pool_v", index("u", "a"), index("v", "b"))
    end = lambda c: pools.select(F.col("pool").alias(f"pool_{c}"), F.col("index").alias("ia" if c == "u" else "ib"), F.col("node").alias("a" if c == "u" else "b"))
    drawn = tries.join(end("u"), ["pool_u", "ia"]).join(end("v"), ["pool_v", "ib"]).filter("a <> b")
    drawn = drawn.select("p", "j", F.least("a", "b").alias("nu"), F.greatest("a", "b").alias("nv"))
    fresh = drawn.join(known.select(F.col("u").alias("nu"), F.col("v").alias("nv")), ["nu", "nv"], "left_anti")
    first = fresh.groupBy("nu", "nv").agg(F.min(F.struct("p", "j")).alias("d")).select("nu", "nv", "d.*")
    rank = F.row_number().over(Window.partitionBy("p").orderBy("j"))
    return first.withColumn("r", rank).filter(F.col("r") <= per_positive).select(F.col("nu").alias("u"), F.col("nv").alias("v"))


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """``df`` with a column split: shares of 10000 hash slots, in the order given; the last takes the rest."""
    slot, at, out = draw(F.lit(str(seed)), F.col(key).cast("string")) % 10000, 0.0, None
    names = list(shares)
    for name in names[:-1]:
        at += shares[name]
        out = (F.when if out is None else out.when)(slot < round(at * 10000), name)
    return df.withColumn("split", out.otherwise(names[-1]) if out is not None else F.lit(names[-1]))


def fold(key: str, k: int = 5, seed: int = 42) -> Column:
    return (draw(F.lit(str(seed)), F.col(key).cast("string")) % k).cast("int")
