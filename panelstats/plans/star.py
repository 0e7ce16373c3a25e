"""Staging to the star schema: one dimension and three facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import anomaly_severity, anomaly_type, cumulative_return, day_direction
from ..operators.aggregates import series_stats
from ..operators.joins import dim_with_stats
from ..operators.quality import filter_abs
from ..operators.series import drawdown, moving_avg, rolling_vol
from ..spec import PanelSpec
from .staging import daily_only


def build_dim(attrs: DataFrame, staging: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Attributes of every instrument with its date range, row count and average volume."""
    return dim_with_stats(attrs, series_stats(staging, spec.key, spec.ts, spec.volume), spec.key)


# Names and order of the published columns.


def price_fact(staging: DataFrame, spec: PanelSpec = PanelSpec(), keep: Sequence[str] = ()) -> DataFrame:
    return staging.select(
        *keep,
        *spec.grid,
        *spec.measures,
        "close_norm",
        "daily_return",
        "return_zscore",
        "volume_zscore",
        "is_volume_outlier",
        spec.version,
        cumulative_return("close_norm", spec.base).alias("cumulative_return"),
        day_direction("daily_return").alias("day_direction"),
    )


def rolling_fact(staging: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Moving averages, annualised volatility and drawdown; all frames share one sort."""
    daily_only(spec)
    key, ts, price = spec.key, spec.ts, spec.close
    df = staging.select(*spec.grid, price, "daily_return", "close_norm")
    for rows in spec.sma_frames:
        df = moving_avg(df, key, ts, price, rows)
    df = rolling_vol(
        df, key, ts, "daily_return", spec.vol_frame, spec.periods_per_year, out=spec.volatility
    )
    return drawdown(df, key, ts, price).drop(price)


def anomaly_fact(staging: DataFrame, spec: PanelSpec = PanelSpec(), keep: Sequence[str] = ()) -> DataFrame:
    """Rows whose return is unusual for their series, with direction and severity."""
    unusual = filter_abs(staging, "return_zscore", spec.anomaly_z)
    return unusual.select(
        *keep,
        *spec.grid,
        spec.close,
        "daily_return",
        "return_zscore",
        spec.volume,
        "volume_zscore",
        anomaly_type("daily_return").alias("anomaly_type"),
        anomaly_severity(F.col("return_zscore"), spec.high_z, spec.extreme_z).alias("anomaly_severity"),
    )
