"""Queries over zones that deliveries changed (refreshed buckets, summaries, appended days), and over pairs of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.operators import aggregates as agg
from panelstats.operators import history, joins
from panelstats.operators.appended import AppendedPanel
from panelstats.plans import distribution, star, summaries
from panelstats.plans.lasting import create_views
from panelstats.sources import panel, placement, sinks

from . import market
from .oracle import r, sql
from .queries import _DAYS, _HISTOGRAM, _PERFORMANCE, _RISK, _VOLATILITY, K, QUERIES, SPEC, TICKS, parallelism, query, rounded
from .zones import Zones


def renewed(text: str) -> str:
    """SQL over the panel as SQL over the panel after the delivery."""
    for name in ("staging", "prices", "anomalies", "dim"):
        text = text.replace(f"from {name}", f"from new_{name}").replace(f"join {name}", f"join new_{name}")
    return text


@query(
    "refresh_star",
    sql(
        f"""
        select p.date, p.ticker, category, trading_days, p."close", {r('p.close_norm', 6, 'close_norm')}, {r('sma_252', 9)},
               {r('drawdown', 6)}, {r('p.return_zscore', 6, 'return_zscore')}, anomaly_severity
        from new_prices p join new_rolling r on p.ticker = r.ticker and p.date = r.date
        join new_dim d on p.ticker = d.ticker
        left join new_anomalies a on p.ticker = a.ticker and p.date = a.date
        """,
        "new_prices",
        "new_rolling",
        "new_anomalies",
        "new_dim",
    ),
)
def _refresh_star(z: Zones) -> DataFrame:
    """Dimension and facts side by side, after the delivery went through all zones bucket by bucket."""
    tables = z.refreshed.open()
    wide = joins.star_join(
        tables["fact_prices"], tables["fact_rolling"], tables["dim_etf"], SPEC.grid,
        ["close", "close_norm", "return_zscore"], ["sma_252", "drawdown"], ["category", "trading_days"],
    )
    marked = tables["fact_anomalies"].select(*SPEC.grid, "anomaly_severity")
    return rounded(wide.join(marked, SPEC.grid, "left"), sma_252=9)


query("refresh_dim", sql("select * from new_dim", "new_dim"))(lambda z: z.refreshed.open()["dim_etf"])


@query("refresh_raw", sql("select * from new_raw", "new_raw"))
def _refresh_raw(z: Zones) -> DataFrame:
    return panel.read_panel(z.spark, z.refreshed.path("raw"), SPEC).drop(sinks.BUCKET)


def summary(name: str, oracle: str | None, *needs: str):
    return query(f"summary_{name}", sql(renewed(oracle), *needs))


def _dim(z: Zones) -> DataFrame:
    return z.refreshed.open()["dim_etf"]


def _of(z: Zones, name: str) -> DataFrame:
    return z.refreshed.summaries()[f"summary_{name}"]


summary("category_performance", _PERFORMANCE, "new_staging", "attrs")(
    lambda z: summaries.category_performance(_of(z, "days"), SPEC)
)
summary("category_volatility", _DAYS + _VOLATILITY, "new_staging", "attrs")(
    lambda z: summaries.category_volatility(_of(z, "months"), _dim(z), SPEC)
)
summary("risk_return", _DAYS + _RISK, "new_staging", "attrs")(
    lambda z: summaries.risk_return(_of(z, "months"), _dim(z), SPEC)
)
summary("risk_return_last", _DAYS + _RISK.replace("max(close_norm)", "arg_max(close_norm, date)"), "new_staging", "attrs")(
    lambda z: summaries.risk_return(_of(z, "months"), _dim(z), SPEC, total="last")
)
summary("return_histogram", _HISTOGRAM, "new_staging", "attrs")(
    lambda z: summaries.return_histogram(_of(z, "histogram"), _dim(z), SPEC)
)
summary(
    "volatility_heatmap",
    _DAYS
    + f"""
    select ticker, etf_name, category, strftime(date, '%Y-%m') year_month, cast(year(date) as integer) "year",
           cast(month(date) as integer) "month", {r('avg(vol)', 4, 'avg_volatility')}, {r('avg(daily_return)', 4, 'avg_daily_return')},
           {r('(max(close_norm) - min(close_norm)) / nullif(min(close_norm), 0)', 4, 'monthly_range')}
    from days group by 1, 2, 3, 4, 5, 6
    """,
    "new_staging",
    "attrs",
)(lambda z: summaries.volatility_heatmap(_of(z, "months"), _dim(z), SPEC))
summary(
    "anomalies_by_category",
    """
    select category, count(*) anomalie_totali, sum(cast(daily_return > 0 as bigint))::bigint spike_up,
           sum(cast(daily_return <= 0 as bigint))::bigint spike_down, sum(cast(abs(return_zscore) > 4 as bigint))::bigint "extreme"
    from staging join attrs using (ticker) where abs(return_zscore) > 2.5 group by 1
    """,
    "new_staging",
    "attrs",
)(lambda z: summaries.anomalies_by_category(_of(z, "anomalies"), _dim(z), SPEC))


# Days appended to series of any length

#: Ends of the first deliveries of the ticks.
ENDS = ("2024-01-11", "2024-01-21", None)


def appended_ticks(z: Zones) -> AppendedPanel:
    """The ticks in three deliveries by time."""
    panel = AppendedPanel(z.spark, z.scratch("appended"), TICKS, parallelism(z, 32))
    bars, begin = market.tick_bars(z.spark, z.sf_dir), None
    for end in ENDS:
        some = bars if begin is None else bars.filter(F.col("date") >= F.lit(begin).cast("timestamp_ntz"))
        panel.append(some if end is None else some.filter(F.col("date") < F.lit(end).cast("timestamp_ntz")))
        begin = end
    return panel


@query("tick_star_appended", QUERIES["tick_star"][1])
def _tick_star_appended(z: Zones) -> DataFrame:
    """As ``tick_star``, of series that grew by three deliveries."""
    panel = appended_ticks(z)
    staging = panel.staging()
    both = joins.align_facts(
        star.price_fact(staging, TICKS), panel.rolling(), TICKS.grid, ["close", "close_norm"], ["sma_20", "drawdown"]
    )
    found = agg.row_count(star.anomaly_fact(staging, TICKS), [K], "anomalies")
    named = joins.dim_with_stats(panel.series().select(K), found, K)
    return rounded(joins.with_dim(both, named, K, ["anomalies"]).fillna(0, ["anomalies"]), sma_20=9)


query(
    "tick_series_appended",
    sql(
        """
        select ticker, min(date) first_date, max(date) last_date, count(*) trading_days, round(avg(volume), 0) avg_daily_volume
        from tick_staging group by 1
        """,
        "tick_staging",
    ),
)(lambda z: appended_ticks(z).series())


# Pairs of series

query(
    "correlated_pairs",
    sql(
        f"""
        , moved as (
          select ticker, date, daily_return x from prices where daily_return is not null
          union all
          select prefix || ticker, date, case when (cast(substr(ticker, 4) as bigint) + dayofyear(date)) % every = 0 then -daily_return else daily_return end
          from prices, (values ('TWIN', 25), ('SHADOW', 60)) as t(prefix, every) where daily_return is not null),
        days as (select ticker, count(*) n from moved group by 1)
        select a.ticker key_a, b.ticker key_b, count(*) as days, {r('corr(a.x, b.x)', 6, 'correlation')}
        from moved a join moved b on a.date = b.date and a.ticker < b.ticker
        join days m on m.ticker = a.ticker join days n on n.ticker = b.ticker
        group by 1, 2 having count(*) >= 0.9 * greatest(any_value(m.n), any_value(n.n)) and corr(a.x, b.x) >= 0.8
        """,
        "prices",
    ),
)(lambda z: rounded(distribution.correlated_pairs(market.with_twins(z.prices), 0.8, SPEC)))


# Dimension with history

_MOVED = """
    , versions as (
      select ticker, etf_name, case when v = 1 then 'MOVED' else category end category,
             case when v = 1 then date '1998-06-01' else date '1990-01-01' end valid_from,
             case when v = 0 and exchange = 'LSE' then date '1998-06-01' end valid_to
      from attrs, (values (0), (1)) as t(v) where v = 0 or exchange = 'LSE')
"""


def _history(z: Zones) -> DataFrame:
    """All instruments from 1990 on; those of one exchange change their category in June 1998."""
    names = z.attrs.select("ticker", "etf_name", "category")
    moved = z.attrs.withColumn("category", F.when(F.col("exchange") == "LSE", "MOVED").otherwise(F.col("category")))
    first = history.merge_dim(None, names, "1990-01-01", K)
    again = history.merge_dim(first, names, "1995-01-01", K)  # nothing new
    return history.merge_dim(again, moved.select("ticker", "etf_name", "category"), "1998-06-01", K)


query("merge_dim", sql(_MOVED + "select * from versions", "attrs", "raw"))(_history)
query(
    "with_dim_as_of",
    sql(
        _MOVED
        + """
        select p.ticker, date, "close", category from prices p
        join versions v on p.ticker = v.ticker and date >= valid_from and date < coalesce(valid_to, date '9999-12-31')
        """,
        "attrs",
        "prices",
    ),
)(lambda z: history.with_dim_as_of(z.prices.select("ticker", "date", "close"), _history(z), K, "date", ["category"]))


# Slices by day


@query(
    "price_slice",
    sql(f"""select ticker, date, "close", {r('daily_return', 6)} from prices where date >= date '1997-06-01' and date < date '1997-07-01'""", "prices"),
)
def _price_slice(z: Zones) -> DataFrame:
    """One month of all series, of a fact placed by day and key."""
    prices = z.prices.select("ticker", "date", "close", "daily_return")
    fact = placement.write_interleaved(prices, z.scratch("interleaved"), SPEC, parallelism(z, 64))
    return rounded(placement.slice_of(fact, SPEC, "1997-06-01", "1997-07-01"))


# Views of the catalog


@query("stored_view", sql(_DAYS + _RISK, "staging", "attrs"))
def _stored_view(z: Zones) -> DataFrame:
    """A stored view, read by another session."""
    z.star
    create_views(z.warehouse)
    return z.spark.newSession().sql("select * from v_risk_return")
