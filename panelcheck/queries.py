"""Every operator, table, view and report as a query over the test tables, with its SQL twin.

A query is ``name -> (DataFrame builder over the zones, SQL or None)``.  Unrounded measures are
rounded on both sides before they are compared: averages of prices to 9 digits, the rest to 6.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstats.functions import scalars as fn
from panelstats.operators import aggregates as agg
from panelstats.operators import joins, ordering, quality, segments, series
from panelstats.operators.calendar import densify
from panelstats.plans import distribution, reports, star, views
from panelstats.plans.segmented import write_segmented_star
from panelstats.plans.staging import build_staging, clean_bars
from panelstats.plans.warehouse import publish
from panelstats.sources import ingest, metrics, panel, sinks
from panelstats.spec import INSTANT, PanelSpec

from . import market
from .oracle import r, sql
from .zones import Zones

Query = tuple[Callable[[Zones], DataFrame], str | None]
QUERIES: dict[str, Query] = {}

SPEC = PanelSpec()
TICKS = PanelSpec(grain=INSTANT)


def parallelism(z: Zones, least: int = 1) -> int:
    """Range partitions or buckets to use: those of the session, yet enough to cut series in a test."""
    return max(least, int(z.spark.conf.get("spark.sql.shuffle.partitions")))



def query(name: str, oracle: str | None):
    def register(build: Callable[[Zones], DataFrame]):
        QUERIES[name] = (build, oracle)
        return build

    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all double columns, those in ``special`` to their own number of digits."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in doubles})


# Sources and sinks

query(
    "landed_bars",
    sql('select * from raw', "raw"),
)(lambda z: market.raw_bars(z.spark, z.sf_dir))


@query("read_panel", sql("select * from raw", "raw"))
def _read_panel(z: Zones) -> DataFrame:
    path = z.scratch("raw")
    sinks.replace_keys(z.raw, path, SPEC, buckets=z.parts)
    return panel.read_panel(z.spark, path, SPEC).drop(sinks.BUCKET)


@query("read_zone", sql('select ticker, date, "close", volume from staging', "staging"))
def _read_zone(z: Zones) -> DataFrame:
    z.staging
    return panel.read_zone(z.spark, z.warehouse.path("staging")).select("ticker", "date", "close", "volume")


@query(
    "normalize_bars",
    sql(
        """
        select ticker, s_name etf_name, cast(date as timestamp) + interval 123 millisecond date,
               "open", high, low, "close", volume, '2002-01-03' ingestion_date
        from raw left join supplier on 'SUP' || lpad(cast(s_suppkey as varchar), 9, '0') = ticker
        """,
        "raw",
    ),
)
def _normalize(z: Zones) -> DataFrame:
    """Bars stamped at midnight of their own exchange, as instants; years of summer-time changes."""
    zone = F.when(F.col("exchange") == "LSE", "Europe/London").otherwise("America/New_York")
    names = z.attrs.withColumn("zone", zone)
    midnight = F.col("date").cast("timestamp_ntz") + F.expr("interval 123456 microseconds")
    instant = F.convert_timezone(F.col("zone"), F.current_timezone(), midnight).cast("timestamp")
    vendor = z.raw.join(names.select("ticker", "zone"), "ticker").select(
        instant.alias("Date"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.col("close").alias("Close"),
        F.col("volume").alias("Volume"),
        F.lit(0.0).alias("Stock Splits"),
        F.col("ticker").alias("Ticker"),
    )
    return panel.normalize_bars(vendor, SPEC, "2002-01-03", names, zone="zone")


query(
    "clip_history",
    sql("select * from raw where date >= date '1997-01-01' and date < date '1999-01-01'", "raw"),
)(lambda z: panel.clip_history(z.raw, "1997-01-01", "1999-01-01", SPEC))


@query(
    "replace_keys",
    sql(
        """
        select * from raw where ticker not in (select ticker from attrs where exchange = 'LSE')
        union all
        select ticker, etf_name, date, "open", high, low, "close", volume, ingestion_date
        from dedup where ticker in (select ticker from attrs where exchange = 'LSE')
        """,
        "dedup",
        "attrs",
    ),
)
def _replace_keys(z: Zones) -> DataFrame:
    """The whole raw zone lands first; then one exchange delivers its histories again."""
    path = z.scratch("replaced")
    sinks.replace_keys(z.raw, path, SPEC, buckets=z.parts)
    listed = z.attrs.filter(F.col("exchange") == "LSE").select("ticker")
    arriving = quality.dedup(z.raw, SPEC.grid, latest=SPEC.version).join(listed, "ticker", "left_semi")
    sinks.replace_keys(arriving, path, SPEC, buckets=z.parts)
    return panel.read_panel(z.spark, path, SPEC, schema=None).drop(sinks.BUCKET)


# The batch is what one exchange delivers; the registry has all instruments.
_STATUS = """
    , batch as (select raw.* from raw join attrs using (ticker) where exchange = 'LSE'),
    status as (
      select a.ticker, count(b.date) "rows",
             case when count(b.date) > 0 then 'processed' else 'failed' end status
      from attrs a left join batch b on a.ticker = b.ticker group by a.ticker)
"""


def _batch(z: Zones) -> DataFrame:
    return z.raw.join(z.attrs.filter(F.col("exchange") == "LSE").select("ticker"), "ticker", "left_semi")


query("ingest_status", sql(_STATUS + " select * from status", "raw", "attrs"))(
    lambda z: ingest.ingest_status(_batch(z), z.attrs, SPEC)
)
query(
    "ingest_summary",
    sql(
        _STATUS
        + """
        select '2002-01-03' run_date, case when p > 0 then 200 else 500 end status_code,
               p n_processed, f n_failed,
               '{"run_date":"2002-01-03","n_processed":' || p || ',"n_failed":' || f || '}' body
        from (select count(*) filter (status = 'processed') p, count(*) filter (status = 'failed') f from status)
        """,
        "raw",
        "attrs",
    ),
)(lambda z: ingest.ingest_summary(_batch(z), z.attrs, "2002-01-03", SPEC))


_PERFORMANCE = f"""
    select a.category, s.date, strftime(s.date, '%Y-%m') year_month,
           {r('sum(close_norm) / count(close_norm)', 2, 'avg_close_norm')},
           {r('100 * sum(daily_return) / count(daily_return)', 4, 'avg_daily_return_pct')},
           {r('sum(close_norm - 100) / count(close_norm)', 2, 'avg_cumulative_return_pct')},
           count(*) etf_count
    from staging s, attrs a where a.ticker = s.ticker group by all
"""


@query("write_fact_by_key", sql(_PERFORMANCE, "staging", "attrs"))
def _write_by_key(z: Zones) -> DataFrame:
    by_category = replace(SPEC, key="category")
    view = views.category_performance(z.prices, z.dim, SPEC, ordered=False)
    return sinks.write_fact(view, z.scratch("by_category"), by_category, layout="key")


@query("write_dim", sql("select * from dim", "dim"))
def _write_dim(z: Zones) -> DataFrame:
    return sinks.write_dim(star.build_dim(z.attrs, z.staging, SPEC), z.scratch("dim"))


_HISTOGRAM = """
    select ticker, category, nth * 0.5 + cast(0 as double) return_bucket, count(*) frequency
    from (select ticker, round(200 * daily_return) nth from staging where daily_return is not null)
    join (select ticker, category from attrs) using (ticker) group by all
"""


@query("export_csv", sql(_HISTOGRAM, "staging", "attrs"))
def _export_csv(z: Zones) -> DataFrame:
    view = views.normalized_prices(z.prices, z.dim, SPEC, ordered=False)
    histogram, path = reports.return_histogram(view, spec=SPEC), z.scratch("csv")
    sinks.export_csv(histogram, path)
    return z.spark.read.schema(histogram.schema).option("header", True).csv(path)


query(
    "staging_metrics",
    sql(
        """
        select 'raw_rows' metric, (select count(*) from raw) "value"
        union all select 'duplicates_removed', (select count(*) from raw) - (select count(*) from dedup)
        union all select 'rows_after_fill', (select count(*) from clean)
        union all select 'volume_outliers', (select count(*) from staging where is_volume_outlier)
        union all select 'failed_casts', 0
        """,
        "staging",
    ),
)(lambda z: metrics.staging_metrics(z.raw, z.staging, SPEC))
query(
    "table_counts",
    sql(
        """
        select 'dim_etf' "table", count(*) "rows" from dim
        union all select 'fact_prices', count(*) from prices
        union all select 'fact_rolling', count(*) from rolling
        union all select 'fact_anomalies', count(*) from anomalies
        """,
        "dim",
        "prices",
        "rolling",
        "anomalies",
    ),
)(lambda z: metrics.table_counts(z.star))


# Projections, labels and filters


def _as_text(z: Zones) -> DataFrame:
    """Raw bars as text: gaps as ``n/a``, volumes of odd days with a decimal point."""
    volume = F.when(F.day("date") % 2 == 1, F.concat(F.col("volume").cast("string"), F.lit(".0"))).otherwise(
        F.col("volume").cast("string")
    )
    text = {c: F.col(c).cast("string") for c in z.raw.columns} | {"volume": volume}
    return z.raw.select(
        *[(F.coalesce(t, F.lit("n/a")) if c in SPEC.measures else t).alias(c) for c, t in text.items()]
    )


query("cast_bars", sql("select * from raw", "raw"))(lambda z: quality.cast_bars(_as_text(z), SPEC))
query(
    "failed_casts",
    sql(
        """
        select unnest(['open', 'high', 'low', 'close', 'volume', 'date', 'ticker', 'etf_name', 'ingestion_date']) "column",
               unnest([count(*) - count("open"), count(*) - count(high), count(*) - count(low),
                       count(*) - count("close"), count(*) - count(volume), 0, 0, 0, 0]) failed
        from raw
        """,
        "raw",
    ),
)(lambda z: quality.failed_casts(_as_text(z), SPEC))


def labelled(name: str, source: str, expr: str, build: Callable[[Zones], DataFrame], measure=False):
    out = r(expr, 6, name) if measure else f"{expr} {name}"
    query(name, sql(f"select ticker, date, {out} from {source}", *source.split()[:1]))(build)


def _with(df: DataFrame, name: str, column) -> DataFrame:
    return rounded(df.select(*SPEC.grid, column.alias(name)))


labelled(
    "cumulative_return", "staging", "(close_norm - 100) / 100",
    lambda z: _with(z.staging, "cumulative_return", fn.cumulative_return("close_norm")), measure=True,
)
labelled(
    "day_direction", "staging",
    "case when daily_return > 0 then 'positive' when daily_return < 0 then 'negative' else 'flat' end",
    lambda z: _with(z.staging, "day_direction", fn.day_direction("daily_return")),
)
labelled(
    "anomaly_type", "anomalies", "case when daily_return > 0 then 'spike_up' else 'spike_down' end",
    lambda z: _with(z.anomalies, "anomaly_type", fn.anomaly_type("daily_return")),
)
labelled(
    "anomaly_severity", "staging",
    "case when abs(return_zscore) > 4 then 'extreme' when abs(return_zscore) > 3 then 'high' else 'moderate' end",
    lambda z: _with(z.staging, "anomaly_severity", fn.anomaly_severity("return_zscore")),
)
labelled(
    "volume_outlier_flag", "staging", "abs(volume_zscore) > 3",
    lambda z: _with(z.staging, "volume_outlier_flag", fn.volume_outlier_flag("volume_zscore")),
)
labelled(
    "high_volume_flag", "staging", "coalesce(abs(volume_zscore) > 2, false)",
    lambda z: _with(z.staging, "high_volume_flag", fn.high_volume_flag("volume_zscore")),
)
labelled(
    "return_pct", "staging", "round(daily_return * 100, 4)",
    lambda z: _with(z.staging, "return_pct", fn.pct("daily_return", 4)), measure=True,
)
# Differences within the rounding error of a sum count as none.
_TREND = """
    case when "close" - sma_252 > 1e-12 * abs(sma_252) then 'above_sma252'
         when sma_252 - "close" > 1e-12 * abs(sma_252) then 'below_sma252' else 'at_sma252' end trend_signal
"""
query(
    "trend_signal",
    sql(
        f"""
        select ticker, date, {_TREND} from (
          select ticker, date, "close", avg("close") over (partition by ticker order by date
                 rows between 251 preceding and current row) sma_252 from clean)
        """,
        "clean",
    ),
)(
    lambda z: joins.align_facts(z.prices, z.rolling, SPEC.grid, ["close"], ["sma_252"]).select(
        *SPEC.grid, fn.trend_signal("close", "sma_252").alias("trend_signal")
    )
)
query("drop_unfilled", sql("select * from dedup where \"close\" is not null", "dedup"))(
    lambda z: quality.drop_unfilled(quality.dedup(z.raw, SPEC.grid, SPEC.version), SPEC.close)
)
query(
    "returns_only",
    sql(f"select ticker, date, {r('daily_return', 6)} from staging where daily_return is not null", "staging"),
)(lambda z: rounded(quality.returns_only(z.staging).select(*SPEC.grid, "daily_return")))
query(
    "filter_abs",
    sql(f"select ticker, date, {r('return_zscore', 6)} from staging where abs(return_zscore) > 2.5", "staging"),
)(lambda z: rounded(quality.filter_abs(z.staging, "return_zscore", 2.5).select(*SPEC.grid, "return_zscore")))
query("count_flag", sql("select count(*) flagged from staging where is_volume_outlier", "staging"))(
    lambda z: quality.count_flag(z.staging, "is_volume_outlier")
)


# Keyed data quality and series indicators

query("dedup", sql("select * from dedup", "dedup"))(
    lambda z: quality.dedup(z.raw, SPEC.grid, latest=SPEC.version)
)
query("forward_fill", sql("select * from filled", "filled"))(
    lambda z: quality.forward_fill(
        quality.dedup(z.raw, SPEC.grid, SPEC.version), SPEC.key, SPEC.ts, SPEC.measures
    )
)
query("clean_bars", sql("select * from clean", "clean"))(lambda z: clean_bars(z.raw, SPEC))


def indicator(name: str, source: str, col: str, digits: int, build: Callable[[DataFrame], DataFrame]):
    """One derived column over the stored prices of every series."""
    query(name, sql(f"select ticker, date, {r(col, digits)} from {source}", source.split()[0]))(
        lambda z: rounded(
            build(z.staging.select(*SPEC.grid, "close", "volume", "daily_return"))
            .select(*SPEC.grid, col),
            digits,
        )
    )


K, TS = SPEC.key, SPEC.ts
indicator("volume_zscore", "staging", "volume_zscore", 6, lambda d: quality.zscore(d, K, "volume"))
indicator(
    "return_zscore", "staging", "return_zscore", 6,
    lambda d: quality.zscore(d, K, "daily_return", "return_zscore"),
)
indicator(
    "simple_return", "staging", "daily_return", 6,
    lambda d: series.simple_return(d.drop("daily_return"), K, TS, "close"),
)
indicator("rebase", "staging", "close_norm", 6, lambda d: series.rebase(d, K, TS, "close"))
indicator("moving_avg_20", "rolling", "sma_20", 9, lambda d: series.moving_avg(d, K, TS, "close", 20))
indicator("moving_avg_252", "rolling", "sma_252", 9, lambda d: series.moving_avg(d, K, TS, "close", 252))
indicator(
    "rolling_vol", "rolling", "volatility_30_annualized", 6,
    lambda d: series.rolling_vol(d, K, TS, "daily_return", 30, 252),
)
query(
    "running_max",
    sql(
        """
        select ticker, date, max("close") over (partition by ticker order by date
               rows between unbounded preceding and current row) running_max from staging
        """,
        "staging",
    ),
)(lambda z: series.running_max(z.staging.select(*SPEC.grid, "close"), K, TS, "close").drop("close"))
indicator("drawdown", "rolling", "drawdown", 6, lambda d: series.drawdown(d, K, TS, "close"))


# Joins

query(
    "with_dim",
    sql(
        'select p.ticker, date, "close", category, currency from prices p join dim d on p.ticker = d.ticker',
        "prices",
        "dim",
    ),
)(lambda z: joins.with_dim(z.prices.select(*SPEC.grid, "close"), z.dim, K, ["category", "currency"]))
query(
    "align_facts",
    sql(
        f"""
        select ticker, date, "close", {r('"close" / nullif(peak, 0) - 1', 6, 'drawdown')} from (
          select ticker, date, "close", max("close") over (partition by ticker order by date
                 rows between unbounded preceding and current row) peak from clean)
        """,
        "clean",
    ),
)(lambda z: rounded(joins.align_facts(z.prices, z.rolling, SPEC.grid, ["close"], ["drawdown"])))
query(
    "star_join",
    sql(
        f"""
        select p.ticker, p.date, "close", {r('sma_20', 9)}, provider
        from prices p join rolling r on p.ticker = r.ticker and p.date = r.date
        join dim d on p.ticker = d.ticker
        """,
        "prices",
        "rolling",
        "dim",
    ),
)(
    lambda z: rounded(
        joins.star_join(z.prices, z.rolling, z.dim, SPEC.grid, ["close"], ["sma_20"], ["provider"]), 9
    )
)
query(
    "dim_with_stats",
    sql(
        """
        select a.ticker, etf_name, days from attrs a left join (
          select ticker, count(*) as days from anomalies where anomaly_severity = 'extreme' group by ticker) s
        on a.ticker = s.ticker
        """,
        "attrs",
        "anomalies",
    ),
)(
    lambda z: joins.dim_with_stats(
        z.attrs.select("ticker", "etf_name"),
        agg.row_count(z.anomalies.filter(F.col("anomaly_severity") == fn.EXTREME), [K], "days"),
        K,
    )
)


# Aggregations

query("row_count", sql("select ticker, day_direction, count(*) n from prices group by 1, 2", "prices"))(
    lambda z: agg.row_count(z.prices, ["ticker", "day_direction"])
)
query(
    "distinct_count",
    sql("select anomaly_type, count(distinct ticker) n_distinct from anomalies group by 1", "anomalies"),
)(lambda z: agg.distinct_count(z.anomalies, ["anomaly_type"], "ticker"))
query(
    "series_stats",
    sql(
        """
        select ticker, min(date) first_date, max(date) last_date, count(date) trading_days,
               round(avg(volume), 0) avg_daily_volume from staging group by 1
        """,
        "staging",
    ),
)(lambda z: agg.series_stats(z.staging, K, TS, SPEC.volume))
query(
    "extent",
    sql('select ticker, min("close") min_close, max("close") max_close from prices group by 1', "prices"),
)(lambda z: agg.extent(z.prices, [K], "close"))
query(
    "mean_rounded",
    sql(f"select date, {r('avg(volume)', 2, 'mean_volume')} from prices group by 1", "prices"),
)(lambda z: z.prices.groupBy(TS).agg(fn.mean_rounded("volume", 2).alias("mean_volume")))
query(
    "first_by",
    sql(
        """
        select ticker, arg_min("close", date) first_close from dedup where "close" is not null group by 1
        """,
        "dedup",
    ),
)(
    lambda z: quality.dedup(z.raw, SPEC.grid, SPEC.version)
    .groupBy(K)
    .agg(fn.first_by("close", TS).alias("first_close"))
)
query(
    "label_counts",
    sql(
        """
        select date, count(*) filter (day_direction = 'positive') up,
               count(*) filter (day_direction = 'negative') down from prices group by 1
        """,
        "prices",
    ),
)(
    lambda z: z.prices.groupBy(TS).agg(
        *fn.label_counts(
            {
                "up": F.col("day_direction") == fn.POSITIVE,
                "down": F.col("day_direction") == fn.NEGATIVE,
            }
        )
    )
)
query(
    "range_and_ratio",
    sql(
        f"""
        select ticker, {r('(max("close") - min("close")) / nullif(min("close"), 0)', 6, 'price_range')},
               {r('max(cumulative_return) / nullif(avg(volume_zscore * volume_zscore), 0)', 6, 'gain_to_volume')}
        from prices group by 1
        """,
        "prices",
    ),
)(
    lambda z: rounded(
        z.prices.groupBy(K).agg(
            fn.rel_range("close").alias("price_range"),
            fn.ratio(
                F.max("cumulative_return"), F.avg(F.col("volume_zscore") * F.col("volume_zscore"))
            ).alias("gain_to_volume"),
        )
    )
)
query(
    "group_by_month",
    sql(
        """
        select strftime(date, '%Y-%m') year_month, cast(year(date) as integer) "year",
               cast(month(date) as integer) "month", count(*) n from prices group by 1, 2, 3
        """,
        "prices",
    ),
)(
    lambda z: agg.row_count(
        z.prices,
        [fn.month_key(TS).alias("year_month"), F.year(TS).alias("year"), F.month(TS).alias("month")],
    )
)
query(
    "sample_deviation",
    sql(f"select ticker, {r('stddev_samp(daily_return)', 9, 'deviation')} from staging group by 1", "staging"),
)(lambda z: rounded(z.staging.groupBy(K).agg(F.stddev_samp("daily_return").alias("deviation")), 9))


# Sorts and limits

query(
    "sort_by_expression",
    sql(f"select ticker, date, {r('return_zscore', 6)} from anomalies", "anomalies"),
)(
    lambda z: rounded(
        ordering.sorted_view(
            z.anomalies.select(*SPEC.grid, "return_zscore"),
            F.abs("return_zscore").desc_nulls_last(),
            K,
            f"-{TS}",
        )
    )
)
query(
    "top_k",
    sql(
        """
        select ticker, date, volume from prices
        order by volume desc nulls last, ticker, date limit 10
        """,
        "prices",
    ),
)(lambda z: ordering.top_k(z.prices.select(*SPEC.grid, "volume"), "volume", 10, tie=SPEC.grid))


# Tables

_STAGING_COLUMNS = f"""
    ticker, etf_name, date, "open", high, low, "close", volume, ingestion_date, is_volume_outlier,
    {r('volume_zscore', 6)}, {r('daily_return', 6)}, {r('return_zscore', 6)}, {r('close_norm', 6)}
"""
_ROLLING_COLUMNS = f"""
    date, ticker, {r('daily_return', 6)}, {r('close_norm', 6)}, {r('sma_20', 9)}, {r('sma_252', 9)},
    {r('volatility_30_annualized', 6)}, {r('drawdown', 6)}
"""
SMAS = {"sma_20": 9, "sma_252": 9}

query("staging", sql(f"select {_STAGING_COLUMNS} from staging", "staging"))(
    lambda z: rounded(build_staging(z.raw, SPEC))
)
query("dim_etf", sql("select * from dim", "dim"))(lambda z: star.build_dim(z.attrs, z.staging, SPEC))
query(
    "fact_prices",
    sql(
        f"""
        select date, ticker, "open", high, low, "close", volume, {r('close_norm', 6)},
               {r('daily_return', 6)}, {r('return_zscore', 6)}, {r('volume_zscore', 6)}, is_volume_outlier,
               ingestion_date, {r('cumulative_return', 6)}, day_direction
        from prices
        """,
        "prices",
    ),
)(lambda z: rounded(star.price_fact(z.staging, SPEC)))
query("fact_rolling", sql(f"select {_ROLLING_COLUMNS} from rolling", "rolling"))(
    lambda z: rounded(star.rolling_fact(z.staging, SPEC), **SMAS)
)
query(
    "fact_anomalies",
    sql(
        f"""
        select date, ticker, "close", {r('daily_return', 6)}, {r('return_zscore', 6)}, volume,
               {r('volume_zscore', 6)}, anomaly_type, anomaly_severity from anomalies
        """,
        "anomalies",
    ),
)(lambda z: rounded(star.anomaly_fact(z.staging, SPEC)))


# The same tables for series cut into segments


@query("staging_segmented", sql(f"select {_STAGING_COLUMNS} from staging", "staging"))
def _segmented_staging(z: Zones) -> DataFrame:
    cut = segments.segmented_staging(z.raw, SPEC, z.scratch("segmented"), parallelism(z, 64))
    return rounded(cut.unsegmented())


@query("fact_rolling_segmented", sql(f"select {_ROLLING_COLUMNS} from rolling", "rolling"))
def _segmented_rolling(z: Zones) -> DataFrame:
    cut = segments.split(z.staging, SPEC, z.scratch("segmented"), parallelism(z, 64))
    return rounded(segments.segmented_rolling(cut), **SMAS)


@query("tick_staging", sql(f"select {_STAGING_COLUMNS} from tick_staging", "tick_staging"))
def _tick_staging(z: Zones) -> DataFrame:
    cut = segments.segmented_staging(market.tick_bars(z.spark, z.sf_dir), TICKS, z.scratch("ticks"), parallelism(z, 64))
    return rounded(cut.unsegmented())


@query("tick_rolling", sql(f"select {_ROLLING_COLUMNS} from tick_rolling", "tick_rolling"))
def _tick_rolling(z: Zones) -> DataFrame:
    cut = segments.segmented_index(market.tick_bars(z.spark, z.sf_dir), TICKS, z.scratch("ticks"), parallelism(z, 64))
    return rounded(segments.segmented_rolling(cut), **SMAS)


@query(
    "tick_star",
    sql(
        f"""
        select t.ticker, t.date, "close", {r('close_norm', 6)}, {r('sma_20', 9)}, {r('drawdown', 6)}, n "anomalies"
        from (select ticker, date, "close", close_norm, "close" / nullif(peak, 0) - 1 drawdown, sma_20 from (
                select *, max("close") over (w rows between unbounded preceding and current row) peak,
                       avg("close") over (w rows between 19 preceding and current row) sma_20
                from tick_staging window w as (partition by ticker order by date))) t
        left join (select ticker, count(*) filter (abs(return_zscore) > 2.5) n from tick_staging group by 1) using (ticker)
        """,
        "tick_staging",
    ),
)
def _tick_star(z: Zones) -> DataFrame:
    """Both facts of the ticks and the anomalies of each stream, from the stored star."""
    cut = segments.segmented_staging(market.tick_bars(z.spark, z.sf_dir), TICKS, z.scratch("ticks"), parallelism(z, 64))
    streams = cut.rows.select("ticker").distinct()
    tables = write_segmented_star(cut, streams, z.scratch("tick_star"))
    both = joins.align_facts(
        tables["fact_prices"], tables["fact_rolling"], TICKS.grid, ["close", "close_norm"], ["sma_20", "drawdown"]
    )
    found = agg.row_count(tables["fact_anomalies"], [K], "anomalies")
    named = joins.dim_with_stats(tables["dim_etf"].select(K), found, K)
    counted = joins.with_dim(both, named, K, ["anomalies"]).fillna(0, ["anomalies"])
    return rounded(counted, sma_20=9)


# Views

query(
    "v_prices_normalized",
    sql(
        f"""
        select date, ticker, etf_name, provider, category, "close", volume, {r('close_norm', 6)}, {r('daily_return', 6)},
               {r('close_norm / 100 - 1', 6, 'cumulative_return')},
               case coalesce(sign(daily_return), 0) when 1 then 'positive' when -1 then 'negative' else 'flat' end day_direction
        from (select * exclude (etf_name) from staging) join (select ticker, etf_name, provider, category from attrs) using (ticker)
        """,
        "staging",
        "attrs",
    ),
)(lambda z: rounded(views.normalized_prices(z.prices, z.dim, SPEC)))
query("v_category_performance", sql(_PERFORMANCE, "staging", "attrs"))(
    lambda z: views.category_performance(z.prices, z.dim, SPEC)
)
# Written over the whole of a series' indicators per day, not over the two facts.
_DAYS = """
    , days as (
      select ticker, date, daily_return, close_norm, vol, "close" / nullif(peak, 0) - 1 down, etf_name, category, provider
      from (select ticker, date, daily_return, close_norm, "close",
                   stddev_samp(daily_return) over (w rows between 29 preceding and current row) * sqrt(252) vol,
                   max("close") over (w rows between unbounded preceding and current row) peak
            from staging window w as (partition by ticker order by date))
      join (select ticker, etf_name, category, provider from attrs) using (ticker))
"""
_VOLATILITY = f"""
    select category, left(cast(date as varchar), 7) year_month, {r('sum(vol) / count(vol)', 4, 'avg_volatility')},
           {r('100 * min(down)', 2, 'worst_drawdown_pct')}, count(distinct ticker) etf_count
    from days group by all
"""
query("v_category_volatility", sql(_DAYS + _VOLATILITY, "staging", "attrs"))(
    lambda z: views.category_volatility(z.rolling, z.dim, SPEC)
)
_RISK = f"""
    select ticker, etf_name, category, provider, {r('top - 100', 2, 'total_return_pct')},
           {r('100 * vol', 2, 'avg_volatility_pct')}, {r('(top - 100) / 100 / nullif(vol, 0)', 2, 'return_to_risk_ratio')},
           {r('100 * low', 2, 'max_drawdown_pct')}, trading_days
    from (select ticker, any_value(etf_name) etf_name, any_value(category) category, any_value(provider) provider,
                 max(close_norm) top, sum(vol) / count(vol) vol, min(down) low, count(*) trading_days
          from days group by ticker)
"""
query("v_risk_return", sql(_DAYS + _RISK, "staging", "attrs"))(
    lambda z: views.risk_return(z.prices, z.rolling, z.dim, SPEC)
)
query(
    "v_risk_return_last",
    sql(
        _DAYS + _RISK.replace("max(close_norm)", "arg_max(close_norm, date)"),
        "staging",
        "attrs",
    ),
)(lambda z: views.risk_return(z.prices, z.rolling, z.dim, SPEC, total="last"))
query(
    "v_returns_daily",
    sql(
        f"""
        select date, ticker, {r('daily_return', 6)}, {r('close_norm', 6)}, {r('cumulative_return', 6)}
        from prices where daily_return is not null
        """,
        "prices",
    ),
)(lambda z: rounded(views.daily_returns(z.prices, SPEC)))
query(
    "v_volatility_heatmap",
    sql(
        _DAYS
        + f"""
        select ticker, etf_name, category, left(m, 7) year_month, cast(left(m, 4) as integer) "year",
               cast(substr(m, 6, 2) as integer) "month", {r('vol', 4, 'avg_volatility')},
               {r('ret', 4, 'avg_daily_return')}, {r('high / nullif(low, 0) - 1', 4, 'monthly_range')}
        from (select ticker, etf_name, category, cast(date_trunc('month', date) as varchar) m,
                     sum(vol) / count(vol) vol, sum(daily_return) / count(daily_return) ret,
                     max(close_norm) high, min(close_norm) low from days group by all)
        """,
        "staging",
        "attrs",
    ),
)(lambda z: views.volatility_heatmap(z.prices, z.rolling, z.dim, SPEC))
query(
    "v_drawdown_analysis",
    sql(
        _DAYS
        + f"""
        select date, ticker, etf_name, category, {r('100 * down', 2, 'drawdown_pct')}, {r('vol', 4, 'volatility_ann')},
               {r('sma_20', 9)}, {r('sma_252', 9)}, {_TREND}
        from days join (
          select ticker, date, "close", avg("close") over (w rows between 19 preceding and current row) sma_20,
                 avg("close") over (w rows between 251 preceding and current row) sma_252
          from staging window w as (partition by ticker order by date)) using (ticker, date)
        """,
        "staging",
        "attrs",
    ),
)(lambda z: rounded(views.drawdown_analysis(z.prices, z.rolling, z.dim, SPEC), **SMAS))
query(
    "v_anomalies_detail",
    sql(
        f"""
        select date, ticker, etf_name, provider, category, volume, {r('100 * daily_return', 2, 'daily_return_pct')},
               {r('return_zscore', 2)}, {r('volume_zscore', 2)}, if(daily_return > 0, 'spike_up', 'spike_down') anomaly_type,
               list_extract(['moderate', 'high', 'extreme'], 1 + cast(size > 3 as integer) + cast(size > 4 as integer)) anomaly_severity,
               ifnull(volume_zscore not between -2 and 2, false) high_volume_anomaly
        from (select * exclude (etf_name), abs(return_zscore) size from staging)
        join (select ticker, etf_name, provider, category from attrs) using (ticker) where size > 2.5
        """,
        "staging",
        "attrs",
    ),
)(lambda z: views.anomaly_detail(z.anomalies, z.dim, SPEC))


@query("select_from_view", sql(_DAYS + _VOLATILITY, "staging", "attrs"))
def _select_star(z: Zones) -> DataFrame:
    publish(z.star, SPEC)
    return z.spark.sql("select * from v_category_volatility")


# Reports


def _risk(z: Zones) -> DataFrame:
    return views.risk_return(z.prices, z.rolling, z.dim, SPEC, ordered=False)


def _view(z: Zones) -> DataFrame:
    return views.normalized_prices(z.prices, z.dim, SPEC, ordered=False)


query("days_per_key", sql("select ticker, count(*) giorni from prices group by 1", "prices"))(
    lambda z: reports.days_per_key(z.prices, SPEC)
)
query(
    "coverage",
    sql(
        """
        select ticker, count(*) giorni, min(date) prima_data, max(date) ultima_data
        from prices group by 1
        """,
        "prices",
    ),
)(lambda z: reports.coverage(z.prices, SPEC))
query("risk_return_by_category", sql(_DAYS + _RISK, "staging", "attrs"))(
    lambda z: reports.risk_return_by_category(_risk(z), SPEC)
)
query("performance_over_time", sql(_PERFORMANCE, "staging", "attrs"))(
    lambda z: reports.performance_over_time(
        views.category_performance(z.prices, z.dim, SPEC, ordered=False), SPEC
    )
)
query("volatility_over_time", sql(_DAYS + _VOLATILITY, "staging", "attrs"))(
    lambda z: reports.volatility_over_time(
        views.category_volatility(z.rolling, z.dim, SPEC, ordered=False), SPEC
    )
)


def _top_sql(by: str) -> str:
    return sql(
        _DAYS
        + f"""
        select ticker, etf_name, category, total_return_pct, avg_volatility_pct, return_to_risk_ratio,
               max_drawdown_pct from ({_RISK}) order by {by} desc nulls last, ticker limit 5
        """,
        "staging",
        "attrs",
    )


query("top_total_return", _top_sql("total_return_pct"))(
    lambda z: reports.top_total_return(_risk(z), 5, SPEC)
)
query("top_return_to_risk", _top_sql("return_to_risk_ratio"))(
    lambda z: reports.top_return_to_risk(_risk(z), 5, SPEC)
)
query(
    "anomalies_by_category",
    sql(
        """
        select category, count(*) anomalie_totali, count(*) filter (anomaly_type = 'spike_up') spike_up,
               count(*) filter (anomaly_type = 'spike_down') spike_down,
               count(*) filter (anomaly_severity = 'extreme') "extreme"
        from anomalies a join dim d on a.ticker = d.ticker group by 1
        """,
        "anomalies",
        "dim",
    ),
)(lambda z: reports.anomalies_by_category(z.anomalies, z.dim, SPEC))
query("return_histogram", sql(_HISTOGRAM, "staging", "attrs"))(
    lambda z: reports.instrument_histogram(z.prices, z.dim, spec=SPEC)
)
query(
    "category_histogram",
    sql(
        f"""
        select category, return_bucket, cast(sum(frequency) as bigint) frequency
        from ({_HISTOGRAM}) group by 1, 2
        """,
        "staging",
        "attrs",
    ),
)(lambda z: reports.category_histogram(reports.return_histogram(_view(z), spec=SPEC), SPEC))
query(
    "slice_category",
    sql(
        f"""
        select date, p.ticker, {r('close_norm', 6)} from prices p join dim d on p.ticker = d.ticker
        where category = 'ASIA'
        """,
        "prices",
        "dim",
    ),
)(lambda z: rounded(reports.slice_category(_view(z), "ASIA", SPEC).select(TS, K, "close_norm")))


# Distribution and calendar

query(
    "normality",
    sql(
        f"""
        select ticker, n, {r('g', 6, 'skewness')}, {r('k', 6, 'kurtosis')},
               {r('n / 6.0 * (g * g + k * k / 4)', 4, 'jarque_bera')}
        from (select ticker, count(daily_return) n,
                avg(d * d * d) / pow(avg(d * d), 1.5) g, avg(d * d * d * d) / pow(avg(d * d), 2) - 3 k
              from (select *, daily_return - avg(daily_return) over (partition by ticker) d from prices)
              where daily_return is not null group by ticker)
        """,
        "prices",
    ),
)(lambda z: rounded(distribution.normality(quality.returns_only(z.prices), SPEC), jarque_bera=4))


@query(
    "return_correlation",
    sql(
        f"""
        , ret as (select p.ticker, date, daily_return, category from prices p join dim d on p.ticker = d.ticker
                  where daily_return is not null),
        pairs as (select d.ticker key_a, b.first key_b from dim d join (
                    select category, min(ticker) "first" from dim group by 1) b on d.category = b.category
                  where d.ticker <> b.first)
        select key_a, key_b, count(*) as days, {r('corr(a.daily_return, b.daily_return)', 6, 'correlation')}
        from pairs join ret a on a.ticker = key_a join ret b on b.ticker = key_b and a.date = b.date
        group by 1, 2
        """,
        "prices",
        "dim",
    ),
)
def _correlation(z: Zones) -> DataFrame:
    """Every instrument against the first one of its category."""
    lead = z.dim.groupBy("category").agg(F.min("ticker").alias("key_b"))
    pairs = z.dim.select("category", F.col("ticker").alias("key_a")).join(lead, "category")
    pairs = pairs.filter(F.col("key_a") != F.col("key_b"))
    return rounded(distribution.return_correlation(z.prices, pairs, SPEC))


query(
    "densify",
    sql(
        """
        select s.ticker, s.date, "close" from (
          select t.ticker, c.date from
            (select ticker, min(date) a, max(date) b from staging group by 1) t
            join (select distinct date from staging) c on c.date between t.a and t.b) s
        left join staging g on g.ticker = s.ticker and g.date = s.date
        """,
        "staging",
    ),
)(lambda z: densify(z.staging.select(*SPEC.grid, "close"), K, TS))


from . import deliveries  # noqa: E402, F401  (registers its queries)
