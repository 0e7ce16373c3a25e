"""Session settings the bucketed layout profits from."""

from __future__ import annotations

from pyspark.sql import SparkSession

INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def colocate_joins(spark: SparkSession) -> SparkSession:
    """Let tables bucketed by key join on ``(key, ts)`` without an exchange.

    By default Spark only reuses a partitioning for a join if it covers every join key.  Partitioning
    by the series key alone is enough here: a series is bounded by the calendar, so its rows for one
    key fit a task.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark


def exchange_partitions(spark: SparkSession) -> int:
    """Partitions an exchange begins with: adaptive execution may be given more of them than it ends with."""
    own = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = all(spark.conf.get(f"spark.sql.adaptive.{c}", "true") == "true" for c in ("enabled", "coalescePartitions.enabled"))
    return int(spark.conf.get(INITIAL, None) or own) if adaptive else int(own)


def deal(spark: SparkSession, wanted: int) -> int:
    """Let exchanges of the session begin with ``wanted`` partitions, or its shuffle partitions if these are more.

    A fixed number makes partitions grow with the data, until tasks sort on disk.  Adaptive execution puts small
    partitions together again, so a number for the largest table doesn't hurt the others.  Returns the number.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if wanted > least:
        spark.conf.set(INITIAL, str(wanted))
    return max(wanted, least)
