"""Incremental forms of the batch operators, for Structured Streaming.

Each takes a streaming frame and returns one; ``run_available`` drives a query over what is
there and returns the result as a batch frame. State is bounded by watermarks, except for
``latest_performance``, whose state is one row an agent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.session import checkpoint_dir
from ..functions.text import fold_words


def read(spark: SparkSession, folder: str, schema, names: str = "*.parquet", files: int = 100) -> DataFrame:
    """Parquet files of a folder whose names match, as a stream; zoneless times count as the session's zone."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", names).parquet(folder)
    return stream.select(*[F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def mention_counts(mentions: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Mentions and approximate distinct documents per label and folded text: (ts, doc_id, label, text)."""
    x = mentions.withWatermark("ts", delay).withColumn("folded", fold_words(F.col("text")))
    return x.groupBy(F.upper("label").alias("label"), "folded").agg(F.count(F.lit(1)).alias("mentions"), F.approx_count_distinct("doc_id").alias("documents"))


def windowed(events: DataFrame, key: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums of (ts, key, value) in tumbling, or with ``slide`` sliding, windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    x = events.withWatermark("ts", delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a key that pauses of ``gap`` divide."""
    x = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct(events: DataFrame, keys: list[str], delay: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def first_years(assertions: DataFrame) -> DataFrame:
    """(u, v, first_year) of streamed assertions; the state is one row a pair and isn't dropped."""
    return assertions.filter("subject <> object").groupBy(F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v")).agg(F.min("year").alias("first_year"))


def latest_performance(results: DataFrame, alpha: float = 0.1, start: float = 0.5) -> DataFrame:
    """(agent, n, success) after each batch of (agent, pos, ok): an exponential average kept as state, in order of pos within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, start)
        rows = pd.concat(list(batches)).sort_values("pos")
        for ok in rows["ok"]:
            value = (1 - alpha) * value + alpha * float(ok)
        n += len(rows)
        state.update((n, float(value)))
        yield pd.DataFrame({"agent": [key[0]], "n": [n], "success": [value]})

    return results.groupBy("agent").applyInPandasWithState(step, "agent string, n long, success double", "n long, success double", "update", GroupStateTimeout.NoTimeout)


def cached(frame: DataFrame, batch_id: int, path: str, key: str, compute: Callable[[Column], Column]) -> None:
    """For foreachBatch: append (key, value) rows for keys that the cache at ``path`` lacks."""
    spark = frame.sparkSession
    wanted = frame.select(key).distinct()
    try:
        wanted = wanted.join(spark.read.parquet(path), key, "left_anti")
    except Exception as error:  # no cache yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    wanted.withColumn("value", compute(F.col(key))).write.mode("append").parquet(path)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all available input and return what it wrote, as a batch frame.

    Appended rows are written as Parquet with the stream's own checkpoint. In complete or
    update mode each batch is written with its number; of a grouped result the last is returned.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def write(frame: DataFrame, batch_id: int) -> None:
        frame.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/part={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{base}/out/*")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        return out.join(last, "batch").drop("batch")
    return out
