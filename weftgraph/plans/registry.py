"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation, discovery, links, streams, texts

PARTS = (links, curation, texts, discovery, streams)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.ORACLES.items()}
