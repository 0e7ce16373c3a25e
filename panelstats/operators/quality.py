"""Keyed data quality: casts, deduplication, forward fill, z-scores, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import ratio
from ..spec import PanelSpec, so_far, whole_series


def cast_bars(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Bring the bar columns to their canonical types; a value that cannot be cast becomes NULL.

    Whole numbers may come as decimal text (``1000.0``); what follows the point is cut off.  Columns outside
    the canonical bar pass through; a canonical column the input lacks is not added.  ``failed_casts``
    counts what was lost.
    """
    target = {f.name: f.dataType for f in spec.bar_schema().fields}
    return df.select(*[_cast(df, c, target[c]).alias(c) if c in target else F.col(c) for c in df.columns])


def failed_casts(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """``(column, failed)``: how many values of each bar column ``cast_bars`` turns into NULL."""
    target = {f.name: f.dataType for f in spec.bar_schema().fields if f.name in df.columns}
    lost = [F.count_if(F.col(c).isNotNull() & _cast(df, c, t).isNull()).alias(c) for c, t in target.items()]
    return df.agg(*lost).unpivot([], list(target), "column", "failed")


def _cast(df: DataFrame, c: str, to: T.DataType) -> Column:
    if isinstance(to, T.LongType) and isinstance(df.schema[c].dataType, T.StringType):
        return F.coalesce(F.col(c).try_cast(to), F.col(c).try_cast("decimal(38, 9)").try_cast(to))
    return F.col(c).try_cast(to)


def timed(df: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Rows that have a time: a bar without one has no place in a series, whatever its length."""
    return df.filter(F.col(spec.ts).isNotNull())


def dedup(df: DataFrame, keys: Sequence[str], latest: str | None = None) -> DataFrame:
    """Keep one whole row per ``keys``: the one with the greatest ``latest``, NULL counting least.

    Ties are broken by the other columns in their order, so the survivor never depends on the
    physical layout.  Being a plain maximum it is combined before the exchange: a map task forwards
    one row per key, and a heavily copied key does not gather in one task.
    """
    rest = [c for c in ([latest] if latest else []) + df.columns if c not in keys]
    rest = list(dict.fromkeys(rest))
    if not rest:
        return df.dropDuplicates(list(keys))
    unordered = (T.MapType, T.VariantType)
    ranked = [c for c in rest if not isinstance(df.schema[c].dataType, unordered)]
    newest = (
        F.max(F.struct(*rest)) if ranked == rest else F.max_by(F.struct(*rest), F.struct(*ranked))
    )
    survivors = df.groupBy(*keys).agg(newest.alias("_row"))
    return survivors.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def forward_fill(df: DataFrame, key: str | list[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Fill NULL cells of existing rows with the last value before them; no row is created."""
    w = so_far(key, ts)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def drop_unfilled(df: DataFrame, price: str) -> DataFrame:
    """Drop rows whose price is still NULL after the fill, i.e. those before a series starts."""
    return df.dropna(subset=[price])


def zscore(df: DataFrame, key: str | list[str], col: str, out: str | None = None) -> DataFrame:
    """Distance from the series mean in sample standard deviations.

    NULL where the deviation is NULL (fewer than two values) or zero (constant series).
    """
    return zscores(df, key, {out or f"{col}_zscore": col})


def zscores(df: DataFrame, key: str | list[str], wanted: dict[str, str]) -> DataFrame:
    """Several z-scores (``output name -> column``) in a single window pass."""
    w = whole_series(key)
    return df.withColumns(
        {
            out: ratio(F.col(c) - F.avg(c).over(w), F.stddev_samp(c).over(w))
            for out, c in wanted.items()
        }
    )


def returns_only(df: DataFrame, ret: str = "daily_return") -> DataFrame:
    return df.filter(F.col(ret).isNotNull())


def filter_abs(df: DataFrame, col: str, threshold: float = 2.5) -> DataFrame:
    """Rows whose absolute value is strictly above the threshold.

    Written as two comparisons on the bare column, because ``abs(x) > t`` does not reach the
    Parquet row-group filter and ``x > t or x < -t`` does.
    """
    return df.filter((F.col(col) > threshold) | (F.col(col) < -threshold))


def count_flag(df: DataFrame, flag: str, out: str = "flagged") -> DataFrame:
    return df.agg(F.count_if(flag).alias(out))
