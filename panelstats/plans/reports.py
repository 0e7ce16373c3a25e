"""Reports over the star schema and its views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EXTREME, SPIKE_DOWN, SPIKE_UP, bucket, label_counts
from ..operators.aggregates import coverage_stats, row_count
from ..operators.joins import with_dim
from ..operators.ordering import sorted_view, top_k
from ..operators.quality import returns_only
from ..spec import PanelSpec

RISK_COLUMNS = ("total_return_pct", "avg_volatility_pct", "return_to_risk_ratio", "max_drawdown_pct")


# Column names of the published reports (giorni, prima_data, ultima_data, anomalie_totali).


def days_per_key(prices: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return sorted_view(row_count(prices, [spec.key], "giorni"), spec.key)


def coverage(prices: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return sorted_view(
        coverage_stats(prices, spec.key, spec.ts, "giorni", "prima_data", "ultima_data"), spec.key
    )


def risk_return_by_category(risk: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return sorted_view(risk, spec.category, "-total_return_pct", spec.key)


def performance_over_time(performance: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return sorted_view(performance, spec.category, spec.ts)


def volatility_over_time(volatility: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return sorted_view(volatility, spec.category, "year_month")


def top_total_return(risk: DataFrame, k: int = 5, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return _top(risk, "total_return_pct", k, spec)


def top_return_to_risk(risk: DataFrame, k: int = 5, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return _top(risk, "return_to_risk_ratio", k, spec)


def anomalies_by_category(
    anomalies: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Anomalies of every category, in total, by direction and the extreme ones."""
    counted = with_dim(
        anomalies.select(spec.key, "anomaly_type", "anomaly_severity"), dim, spec.key, [spec.category]
    )
    by_label = label_counts(
        {
            "spike_up": F.col("anomaly_type") == SPIKE_UP,
            "spike_down": F.col("anomaly_type") == SPIKE_DOWN,
            "extreme": F.col("anomaly_severity") == EXTREME,
        }
    )
    totals = counted.groupBy(spec.category).agg(F.count("*").alias("anomalie_totali"), *by_label)
    return sorted_view(totals, "-anomalie_totali", spec.category)


def return_histogram(
    view: DataFrame, width: float | None = None, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """Frequency of daily returns (in percent) per instrument and bucket of ``width`` points.

    ``view`` has returns and the category.  Over a price fact, ``instrument_histogram`` counts first and
    looks up the category of the few rows left.
    """
    buckets = bucket(F.col("daily_return") * 100, spec.bucket_width if width is None else width)
    grouping = [spec.key, spec.category, buckets.alias("return_bucket")]
    return sorted_view(row_count(returns_only(view), grouping, "frequency"), spec.key, "return_bucket")


def instrument_histogram(
    prices: DataFrame, dim: DataFrame, width: float | None = None, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """``return_histogram`` from the fact and the dimension."""
    buckets = bucket(F.col("daily_return") * 100, spec.bucket_width if width is None else width)
    counted = row_count(returns_only(prices), [spec.key, buckets.alias("return_bucket")], "frequency")
    with_category = with_dim(counted, dim, spec.key, [spec.category])
    return sorted_view(
        with_category.select(spec.key, spec.category, "return_bucket", "frequency"), spec.key, "return_bucket"
    )


def category_histogram(histogram: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """The instrument histograms added up by category."""
    total = histogram.groupBy(spec.category, "return_bucket").agg(F.sum("frequency").alias("frequency"))
    return sorted_view(total, spec.category, "return_bucket")


def slice_category(view: DataFrame, category: str, spec: PanelSpec = PanelSpec()) -> DataFrame:
    return view.filter(F.col(spec.category) == category)


def _top(risk: DataFrame, by: str, k: int, spec: PanelSpec) -> DataFrame:
    ranked = risk.select(spec.key, spec.name, spec.category, *RISK_COLUMNS)
    return top_k(ranked, by, k, tie=[spec.key])
