"""Grouped counts and per-series statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import col, mean_rounded


def row_count(df: DataFrame, keys: Sequence[str | Column], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def distinct_count(df: DataFrame, keys: Sequence[str | Column], c: str, out: str = "n_distinct") -> DataFrame:
    """Exact.  Spark removes repeated (group, value) pairs before they are gathered by group."""
    return df.groupBy(*keys).agg(F.count_distinct(col(c)).alias(out))


def extent(df: DataFrame, keys: Sequence[str | Column], c: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))


def coverage_stats(df: DataFrame, key: str, ts: str, count: str, first: str, last: str) -> DataFrame:
    """Row count and first and last time of every series."""
    return df.groupBy(key).agg(
        F.count("*").alias(count), F.min(ts).alias(first), F.max(ts).alias(last)
    )


def series_stats(df: DataFrame, key: str, ts: str, volume: str) -> DataFrame:
    """Descriptive statistics that the instrument dimension stores."""
    return df.groupBy(key).agg(
        F.min(ts).alias("first_date"),
        F.max(ts).alias("last_date"),
        F.count(ts).alias("trading_days"),
        mean_rounded(volume, 0).alias("avg_daily_volume"),
    )
