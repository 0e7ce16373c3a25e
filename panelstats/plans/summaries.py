"""Stored partial results that views and reports are merged from without a scan of the facts.

A partial is a count, a sum, a least or a greatest value, so partials of parts of the data add up to those of the
whole.  They are kept by bucket of the key, a directory each, so a delivery rewrites those of its buckets.

* ``summary_months``: per series and month, for volatility, drawdown, return and price range;
* ``summary_days``: per category, day and bucket, for the category's mean level and return;
* ``summary_anomalies``: per series, anomalies by label;
* ``summary_histogram``: per series and bucket of its returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EXTREME, SPIKE_DOWN, SPIKE_UP, bucket, label_counts, month_key, pct, ratio
from ..operators.joins import align_facts, with_dim
from ..operators.ordering import sorted_view
from ..operators.quality import returns_only
from ..sources.schema import store_schema
from ..sources.sinks import BUCKET, bucket_files, bucket_of, drop_left_over
from ..spec import PanelSpec

SUMMARIES = ("summary_months", "summary_days", "summary_anomalies", "summary_histogram")


def month_partials(prices: DataFrame, rolling: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per series and month what the monthly views and the risk of a series need."""
    daily = align_facts(
        prices, rolling, spec.grid, ["daily_return", "close_norm", "cumulative_return"], [spec.volatility, "drawdown"]
    )
    return daily.groupBy(spec.key, month_key(spec.ts).alias("year_month")).agg(
        F.count("*").alias("days"),
        F.sum(spec.volatility).alias("vol_sum"),
        F.count(spec.volatility).alias("vol_n"),
        F.min("drawdown").alias("worst"),
        F.sum("daily_return").alias("ret_sum"),
        F.count("daily_return").alias("ret_n"),
        F.min("close_norm").alias("norm_min"),
        F.max("close_norm").alias("norm_max"),
        F.max("cumulative_return").alias("gain_peak"),
        F.max(F.struct(spec.ts, "cumulative_return")).alias("gain_last"),
    )


def day_partials(prices: DataFrame, dim: DataFrame, buckets: int, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Per category, day and bucket of keys the sums of levels and returns."""
    wanted = ("close_norm", "daily_return", "cumulative_return")
    daily = prices.select(*spec.grid, *wanted, bucket_of(spec.key, buckets).alias(BUCKET))
    daily = with_dim(daily, dim, spec.key, [spec.category])
    return daily.groupBy(BUCKET, spec.category, spec.ts).agg(
        *[F.sum(c).alias(f"{c}_sum") for c in wanted], *[F.count(c).alias(f"{c}_n") for c in wanted], F.count("*").alias("etf_count")
    )


def anomaly_partials(anomalies: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    labels = {
        "spike_up": F.col("anomaly_type") == SPIKE_UP,
        "spike_down": F.col("anomaly_type") == SPIKE_DOWN,
        "extreme": F.col("anomaly_severity") == EXTREME,
    }
    return anomalies.groupBy(spec.key).agg(F.count("*").alias("total"), *label_counts(labels))


def histogram_partials(prices: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    buckets = bucket(F.col("daily_return") * 100, spec.bucket_width)
    return returns_only(prices).groupBy(spec.key, buckets.alias("return_bucket")).agg(F.count("*").alias("frequency"))


def partials(star: dict[str, DataFrame], spec: PanelSpec, buckets: int) -> dict[str, DataFrame]:
    """All summaries of a star schema, or of some buckets of it, with the bucket of their keys."""
    prices, rolling = star["fact_prices"], star["fact_rolling"]
    number = bucket_of(spec.key, buckets).alias(BUCKET)
    by_key = {
        "summary_months": month_partials(prices, rolling, spec),
        "summary_anomalies": anomaly_partials(star["fact_anomalies"], spec),
        "summary_histogram": histogram_partials(prices, spec),
    }
    days = day_partials(prices, star["dim_etf"], buckets, spec)
    return {name: df.withColumn(BUCKET, number) for name, df in by_key.items()} | {"summary_days": days}


def store(made: DataFrame, path: str, buckets: int, touched: list[int] | None = None) -> None:
    """Write a summary, or the touched buckets of one; touched ones without a row become empty."""
    spark = made.sparkSession
    columns = [c for c in made.columns if c != BUCKET]
    if touched is None:
        touched = list(range(buckets))
    before = bucket_files(spark, path, touched)
    (
        made.select(*columns, BUCKET)
        .hint("rebalance", BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(path)
    )
    drop_left_over(spark, path, before)
    store_schema(spark, path, made.select(*columns, BUCKET).schema)


# Views and reports from summaries


def category_performance(days: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True) -> DataFrame:
    """Mean level and return of every category and day."""

    def mean(c: str):
        return ratio(F.sum(f"{c}_sum"), F.sum(f"{c}_n"))

    view = (
        days.groupBy(spec.category, spec.ts)
        .agg(
            F.round(mean("close_norm"), 2).alias("avg_close_norm"),
            pct(mean("daily_return"), 4).alias("avg_daily_return_pct"),
            pct(mean("cumulative_return"), 2).alias("avg_cumulative_return_pct"),
            F.sum("etf_count").alias("etf_count"),
        )
        .withColumn("year_month", month_key(spec.ts))
    )
    return sorted_view(view, spec.category, spec.ts) if ordered else view


def category_volatility(months: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True) -> DataFrame:
    """Mean volatility and worst drawdown of every category and month."""
    view = (
        with_dim(months.select(spec.key, "year_month", "vol_sum", "vol_n", "worst"), dim, spec.key, [spec.category])
        .groupBy(spec.category, "year_month")
        .agg(
            F.round(ratio(F.sum("vol_sum"), F.sum("vol_n")), 4).alias("avg_volatility"),
            pct(F.min("worst"), 2).alias("worst_drawdown_pct"),
            F.count("*").alias("etf_count"),
        )
    )
    return sorted_view(view, spec.category, "year_month") if ordered else view


def risk_return(
    months: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True, total: str = "peak"
) -> DataFrame:
    """Return against risk of every instrument; ``total`` as in the view over facts."""
    if total not in ("peak", "last"):
        raise ValueError(f"total must be 'peak' or 'last', not {total!r}")
    gain = F.max("gain_peak") if total == "peak" else F.max("gain_last")["cumulative_return"]
    per_series = months.groupBy(spec.key).agg(
        gain.alias("gain"),
        ratio(F.sum("vol_sum"), F.sum("vol_n")).alias("risk"),
        F.min("worst").alias("worst"),
        F.sum("days").alias("trading_days"),
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


def volatility_heatmap(months: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec(), ordered: bool = True) -> DataFrame:
    """Volatility, return and price range of every instrument and month."""
    monthly = months.select(
        spec.key,
        "year_month",
        F.substring("year_month", 1, 4).cast("int").alias("year"),
        F.substring("year_month", 6, 2).cast("int").alias("month"),
        F.round(ratio("vol_sum", "vol_n"), 4).alias("avg_volatility"),
        F.round(ratio("ret_sum", "ret_n"), 4).alias("avg_daily_return"),
        F.round(ratio(F.col("norm_max") - F.col("norm_min"), "norm_min"), 4).alias("monthly_range"),
    )
    view = with_dim(monthly, dim, spec.key, [spec.name, spec.category])
    return sorted_view(view, spec.key, "year_month") if ordered else view


def anomalies_by_category(counted: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Anomalies of every category, in total, by direction and the extreme ones."""
    labels = ("spike_up", "spike_down", "extreme")
    own = with_dim(counted.select(spec.key, "total", *labels), dim, spec.key, [spec.category])
    totals = own.groupBy(spec.category).agg(F.sum("total").alias("anomalie_totali"), *[F.sum(c).alias(c) for c in labels])
    return sorted_view(totals, "-anomalie_totali", spec.category)


def return_histogram(histogram: DataFrame, dim: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Frequency of returns per instrument and bucket."""
    own = with_dim(histogram.select(spec.key, "return_bucket", "frequency"), dim, spec.key, [spec.category])
    return sorted_view(own.select(spec.key, spec.category, "return_bucket", "frequency"), spec.key, "return_bucket")
