"""Analysis views over the star schema.

Aggregating views group by series first and look the dimension up afterwards: the facts are unique
per ``(key, ts)`` and bucketed by key, so the first grouping needs no exchange and the join sees a
few rows per series instead of all of them.  ``ordered=False`` leaves the final sort out, for use as
an intermediate result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import high_volume_flag, month_key, pct, ratio, rel_range, trend_signal
from ..operators.joins import align_facts, star_join, with_dim
from ..operators.ordering import sorted_view
from ..operators.quality import returns_only
from ..spec import PanelSpec


def normalized_prices(
    prices: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True
) -> DataFrame:
    """Rebased price series with the attributes of their instrument."""
    measures = [
        spec.close, "close_norm", "cumulative_return", "daily_return", "day_direction", spec.volume
    ]
    attrs = [spec.name, spec.provider, spec.category]
    view = with_dim(prices.select(*spec.grid, *measures), dim, spec.key, attrs)
    view = view.select(spec.ts, spec.key, *attrs, *measures)
    return sorted_view(view, *spec.grid) if ordered else view


def category_performance(
    prices: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True
) -> DataFrame:
    """Mean level and return of every category and day.

    A series has one row per day, so counting rows counts instruments.
    """
    daily = with_dim(
        prices.select(*spec.grid, "close_norm", "daily_return", "cumulative_return"),
        dim,
        spec.key,
        [spec.category],
    )
    view = (
        daily.groupBy(spec.category, spec.ts)
        .agg(
            F.round(F.avg("close_norm"), 2).alias("avg_close_norm"),
            pct(F.avg("daily_return"), 4).alias("avg_daily_return_pct"),
            pct(F.avg("cumulative_return"), 2).alias("avg_cumulative_return_pct"),
            F.count("*").alias("etf_count"),
        )
        .withColumn("year_month", month_key(spec.ts))
    )
    return sorted_view(view, spec.category, spec.ts) if ordered else view


def category_volatility(
    rolling: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True
) -> DataFrame:
    """Mean volatility and worst drawdown of every category and month."""
    per_series = rolling.groupBy(spec.key, month_key(spec.ts).alias("year_month")).agg(
        F.sum(spec.volatility).alias("vol_sum"),
        F.count(spec.volatility).alias("vol_n"),
        F.min("drawdown").alias("worst"),
    )
    view = (
        with_dim(per_series, dim, spec.key, [spec.category])
        .groupBy(spec.category, "year_month")
        .agg(
            F.round(ratio(F.sum("vol_sum"), F.sum("vol_n")), 4).alias("avg_volatility"),
            pct(F.min("worst"), 2).alias("worst_drawdown_pct"),
            F.count("*").alias("etf_count"),
        )
    )
    return sorted_view(view, spec.category, "year_month") if ordered else view


def risk_return(
    prices: DataFrame,
    rolling: DataFrame,
    dim: DataFrame,
    spec: PanelSpec = PanelSpec(),
    ordered: bool = True,
    total: str = "peak",
) -> DataFrame:
    """Return against risk of every instrument.

    ``total="peak"`` takes the highest cumulative return of the history as the total return;
    ``total="last"`` its most recent value.
    """
    if total not in ("peak", "last"):
        raise ValueError(f"total must be 'peak' or 'last', not {total!r}")
    gain = F.col("cumulative_return")
    gain = F.max(gain) if total == "peak" else F.max_by(gain, spec.ts)
    daily = align_facts(
        prices, rolling, spec.grid, ["cumulative_return"], [spec.volatility, "drawdown"]
    )
    per_series = daily.groupBy(spec.key).agg(
        gain.alias("gain"),
        F.avg(spec.volatility).alias("risk"),
        F.min("drawdown").alias("worst"),
        F.count("*").alias("trading_days"),
    )
    attrs = [spec.name, spec.category, spec.provider]
    view = with_dim(per_series, dim, spec.key, attrs).select(
        spec.key,
        *attrs,
        pct("gain", 2).alias("total_return_pct"),
        pct("risk", 2).alias("avg_volatility_pct"),
        F.round(ratio("gain", "risk"), 2).alias("return_to_risk_ratio"),
        pct("worst", 2).alias("max_drawdown_pct"),
        "trading_days",
    )
    return sorted_view(view, "-total_return_pct", spec.key) if ordered else view


def daily_returns(prices: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True) -> DataFrame:
    """Rows that have a return, for studying its distribution."""
    view = returns_only(prices).select(
        spec.ts, spec.key, "daily_return", "close_norm", "cumulative_return"
    )
    return sorted_view(view, spec.ts, spec.key) if ordered else view


def volatility_heatmap(
    prices: DataFrame,
    rolling: DataFrame,
    dim: DataFrame,
    spec: PanelSpec = PanelSpec(),
    ordered: bool = True,
) -> DataFrame:
    """Volatility, return and price range of every instrument and month."""
    daily = align_facts(
        prices, rolling, spec.grid, ["daily_return", "close_norm"], [spec.volatility]
    )
    monthly = daily.groupBy(
        spec.key,
        month_key(spec.ts).alias("year_month"),
        F.year(spec.ts).alias("year"),
        F.month(spec.ts).alias("month"),
    ).agg(
        F.round(F.avg(spec.volatility), 4).alias("avg_volatility"),
        F.round(F.avg("daily_return"), 4).alias("avg_daily_return"),
        F.round(rel_range("close_norm"), 4).alias("monthly_range"),
    )
    view = with_dim(monthly, dim, spec.key, [spec.name, spec.category])
    return sorted_view(view, spec.key, "year_month") if ordered else view


def drawdown_analysis(
    prices: DataFrame,
    rolling: DataFrame,
    dim: DataFrame,
    spec: PanelSpec = PanelSpec(),
    ordered: bool = True,
) -> DataFrame:
    """Drawdown, volatility and averages per day, with the trend against the long average."""
    smas = [c for c in rolling.columns if c.startswith("sma_")]
    attrs = [spec.name, spec.category]
    daily = star_join(
        prices, rolling, dim, spec.grid, [spec.close], ["drawdown", spec.volatility, *smas], attrs
    )
    label = spec.trend_sma.replace("_", "")
    view = daily.select(
        spec.ts,
        spec.key,
        *attrs,
        pct("drawdown", 2).alias("drawdown_pct"),
        F.round(spec.volatility, 4).alias("volatility_ann"),
        *smas,
        trend_signal(spec.close, spec.trend_sma, label, spec.trend_tolerance).alias("trend_signal"),
    )
    return sorted_view(view, *spec.grid) if ordered else view


def anomaly_detail(
    anomalies: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True
) -> DataFrame:
    """Anomalous days with their instrument, newest first, then by size of the z-score.

    The order is that of the unrounded z-score, as the rounded one has many ties.
    """
    attrs = [spec.name, spec.provider, spec.category]
    daily = with_dim(anomalies, dim, spec.key, attrs)
    if ordered:
        size = F.abs("return_zscore").desc_nulls_last()
        daily = sorted_view(daily, f"-{spec.ts}", size, spec.key)
    return daily.select(
        spec.ts,
        spec.key,
        *attrs,
        pct("daily_return", 2).alias("daily_return_pct"),
        F.round("return_zscore", 2).alias("return_zscore"),
        "anomaly_type",
        "anomaly_severity",
        spec.volume,
        F.round("volume_zscore", 2).alias("volume_zscore"),
        high_volume_flag("volume_zscore", spec.high_volume_z).alias("high_volume_anomaly"),
    )
