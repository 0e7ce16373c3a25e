"""Joins of the star: dimension lookups and fact alignment.

No side carries a broadcast hint.  A dimension grows with the number of instruments, so its size is
left to the statistics check (``spark.sql.autoBroadcastJoinThreshold``) and to the adaptive re-plan,
which broadcast it while it is small and fall back to a merge join beyond.  Zones written by
``write_fact(layout="bucket")`` share their bucketing, so that fallback needs no exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def with_dim(fact: DataFrame, dim: DataFrame, key: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Inner lookup of dimension attributes; only ``cols`` of the dimension are carried along."""
    return fact.join(dim if cols is None else dim.select(key, *cols), key)


def align_facts(
    prices: DataFrame,
    rolling: DataFrame,
    keys: Sequence[str],
    left: Sequence[str] | None = None,
    right: Sequence[str] | None = None,
) -> DataFrame:
    """Inner join of two facts on their full key.

    ``left`` and ``right`` choose the measures to keep; by default a measure both sides store
    is taken from the left.
    """
    keys = list(keys)
    left = [c for c in prices.columns if c not in keys] if left is None else list(left)
    right = [c for c in rolling.columns if c not in keys and c not in left] if right is None else list(right)
    return prices.select(*keys, *left).join(rolling.select(*keys, *right), keys)


def star_join(
    prices: DataFrame,
    rolling: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    left: Sequence[str] | None = None,
    right: Sequence[str] | None = None,
    attrs: Sequence[str] | None = None,
) -> DataFrame:
    """Both facts side by side with their dimension; ``keys[0]`` is the dimension key."""
    return with_dim(align_facts(prices, rolling, keys, left, right), dim, keys[0], attrs)


def dim_with_stats(dim: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """Left outer: a member without data keeps its attributes and gets NULL statistics."""
    return dim.join(stats, key, "left")
