"""Streaming queries over the events table, checked against batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming import streams

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _events(spark, d):
    return streams.read(spark, d, table(spark, d, "events").schema, "events.parquet")


@query("SELECT event_type, time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_windows(spark, d):
    x = streams.windowed(_events(spark, d), "event_type", "1 day")
    return streams.run_available(x, "complete").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    x = streams.sessions(_events(spark, d), "user_id", "6 hours")
    return streams.run_available(x, "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT upper(event_type) AS label, 'k' || (user_id % 10) AS folded, count(*) AS mentions FROM events GROUP BY 1, 2")
def stream_mentions(spark, d):
    x = _events(spark, d).select("ts", F.col("event_id").alias("doc_id"), F.col("event_type").alias("label"), F.concat(F.lit("K"), (F.col("user_id") % 10).cast("string")).alias("text"))
    return streams.run_available(streams.mention_counts(x), "complete").select("label", "folded", "mentions")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, d):
    """The keys that a month's watermark lets pass once."""
    x = streams.distinct(_events(spark, d), ["user_id", "event_type"], "60 days")
    return streams.run_available(x).select("user_id", "event_type")


@query("SELECT least(a, b) AS u, greatest(a, b) AS v, min(y)::INTEGER AS first_year FROM (SELECT 'U' || user_id AS a, event_type AS b, 1990 + event_id % 30 AS y FROM events) GROUP BY 1, 2")
def stream_first_years(spark, d):
    x = _events(spark, d).select(F.concat(F.lit("U"), "user_id").alias("subject"), F.col("event_type").alias("object"), (1990 + F.col("event_id") % 30).cast("int").alias("year"))
    return streams.run_available(streams.first_years(x), "complete")


@query("""WITH x AS (SELECT event_type AS agent, (value > 20)::INT AS ok, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT agent, any_value(n) AS n, round(sum(0.1 * 0.9 ** k * ok) + any_value(0.5 * 0.9 ** n), 6) AS success FROM x GROUP BY agent""")
def stream_agent_performance(spark, d):
    x = _events(spark, d).select(F.col("event_type").alias("agent"), F.col("event_id").alias("pos"), (F.col("value") > 20).alias("ok"))
    return streams.run_available(streams.latest_performance(x), "update").select("agent", "n", F.round("success", 6).alias("success"))
