"""The same results as SQL text for DuckDB, written from the definitions and not from the library."""

from __future__ import annotations

# Each entry: name -> body.  ``sql(select, *needed)`` puts the needed ones, and what they need, into
# one WITH clause in this order.
STEPS: dict[str, tuple[tuple[str, ...], str]] = {}


def _step(name: str, needs: tuple[str, ...], body: str) -> None:
    STEPS[name] = (needs, body)


def sql(select: str, *needs: str) -> str:
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in STEPS[name][0]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for n in needs:
        add(n)
    parts = [f"{n} as materialized ({STEPS[n][1].strip()})" for n in wanted]
    return (f"with {', '.join(parts)} " if parts else "") + select.strip()


_step(
    "walk",
    (),
    """
    select sk, date, close_c - move open_c,
           greatest(close_c - move, close_c) + greatest(best, 0) high_c,
           least(close_c - move, close_c) + least(worst, 0) low_c,
           close_c, volume, seq
    from (select sk, date, move, best, worst, volume,
                 50000 + cast(sum(move) over (partition by sk order by date
                              rows between unbounded preceding and current row) as bigint) close_c,
                 row_number() over (partition by sk order by date) seq
          from (select l_suppkey sk, cast(l_shipdate as date) date,
                       cast(sum(step) as bigint) move, max(step) best, min(step) worst,
                       cast(sum(cast(l_quantity as bigint)) as bigint) volume
                from (select *, (cast(round(l_discount * 100) as bigint) - 5) * cast(l_quantity as bigint)
                                * case when l_linenumber = 7 then 3 else 1 end step
                      from lineitem)
                group by 1, 2))
    """,
)
_step(
    "raw",
    ("walk",),
    """
    select 'SUP' || lpad(cast(sk as varchar), 9, '0') ticker,
           'Supplier#' || lpad(cast(sk as varchar), 9, '0') etf_name, date,
           case when not missing then cast(open_c + v * 100 as double) / 100 end "open",
           case when not missing then cast(high_c + v * 100 as double) / 100 end high,
           case when not missing then cast(low_c + v * 100 as double) / 100 end low,
           case when not missing then cast(close_c + v * 100 as double) / 100 end "close",
           case when not (missing or (v = 0 and (sk * 5 + dayofyear(date)) % 29 = 0)) then volume + v end volume,
           case when v = 0 then '2002-01-01' else '2002-01-02' end ingestion_date
    from (select *, v = 0 and ((sk * 7 + dayofyear(date)) % 23 = 0 or (seq = 1 and sk % 4 = 0)) missing
          from (select *, 0 v from walk
                union all select *, 0 v from walk where dayofyear(date) % 13 = 0
                union all select *, 1 v from walk where dayofyear(date) % 11 = 0))
    """,
)


def _panel_steps(p: str) -> None:
    """Raw bars to facts; ``p`` prefixes the step names, so that two panels can be described."""
    fill = (
        "last_value({c} ignore nulls) over (partition by ticker order by date "
        "rows between unbounded preceding and current row) {c}"
    )
    _step(
        f"{p}dedup",
        (f"{p}raw",),
        f"""
        select * exclude (rn) from (
          select *, row_number() over (partition by ticker, date order by ingestion_date desc) rn
          from {p}raw)
        where rn = 1
        """,
    )
    _step(
        f"{p}filled",
        (f"{p}dedup",),
        "select ticker, etf_name, date, ingestion_date, "
        + ", ".join(fill.format(c=c) for c in ('"open"', "high", "low", '"close"', "volume"))
        + f" from {p}dedup",
    )
    _step(f"{p}clean", (f"{p}filled",), f'select * from {p}filled where "close" is not null')
    _step(
        f"{p}staging",
        (f"{p}clean",),
        f"""
        select *, abs(volume_zscore) > 3 is_volume_outlier from (
          select *,
            (volume - avg(volume) over k) / nullif(stddev_samp(volume) over k, 0) volume_zscore,
            (daily_return - avg(daily_return) over k) / nullif(stddev_samp(daily_return) over k, 0) return_zscore
          from (
            select *, ("close" - lag("close") over w) / nullif(lag("close") over w, 0) daily_return,
                   "close" / nullif(first_value("close") over w, 0) * 100 close_norm
            from {p}clean window w as (partition by ticker order by date))
          window k as (partition by ticker))
        """,
    )
    _step(
        f"{p}prices",
        (f"{p}staging",),
        f"""
        select date, ticker, "open", high, low, "close", volume, close_norm, daily_return,
               return_zscore, volume_zscore, is_volume_outlier, ingestion_date,
               (close_norm - 100) / 100 cumulative_return,
               case when daily_return > 0 then 'positive' when daily_return < 0 then 'negative'
                    else 'flat' end day_direction
        from {p}staging
        """,
    )
    _step(
        f"{p}rolling",
        (f"{p}staging",),
        f"""
        select date, ticker, daily_return, close_norm, sma_20, sma_252, volatility_30_annualized,
               ("close" - peak) / nullif(peak, 0) drawdown
        from (select *,
                avg("close") over (w rows between 19 preceding and current row) sma_20,
                avg("close") over (w rows between 251 preceding and current row) sma_252,
                stddev_samp(daily_return) over (w rows between 29 preceding and current row)
                  * sqrt(252) volatility_30_annualized,
                max("close") over (w rows between unbounded preceding and current row) peak
              from {p}staging window w as (partition by ticker order by date))
        """,
    )
    _step(
        f"{p}anomalies",
        (f"{p}staging",),
        f"""
        select date, ticker, "close", daily_return, return_zscore, volume, volume_zscore,
               case when daily_return > 0 then 'spike_up' else 'spike_down' end anomaly_type,
               case when abs(return_zscore) > 4 then 'extreme' when abs(return_zscore) > 3 then 'high'
                    else 'moderate' end anomaly_severity
        from {p}staging where abs(return_zscore) > 2.5
        """,
    )


_panel_steps("")
_step(
    "tick_raw",
    (),
    """
    select event_type ticker, 'Stream of ' || event_type etf_name, ts date,
           p "open", p high, p low, p "close", case when event_id % 29 <> 0 then user_id end volume,
           case when v = 0 then '2002-01-01' else '2002-01-02' end ingestion_date
    from (select *, case when event_id % 23 <> 0 or v = 1 then
                   cast(cast(round(value * 100) as bigint) + 10000 + v * 100 as double) / 100 end p
          from (select *, 0 v from events union all select *, 1 v from events where event_id % 11 = 0))
    """,
)
_panel_steps("tick_")
_step(
    "attrs",
    (),
    """
    select 'SUP' || lpad(cast(s_suppkey as varchar), 9, '0') ticker, s_name etf_name, n_name provider,
           r_name category, 'Index ' || cast(n_nationkey % 7 as varchar) index_tracked,
           case when n_regionkey = 3 then 'EUR' else 'USD' end currency,
           case when n_nationkey % 2 = 0 then 'LSE' else 'NYSE' end exchange
    from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    """,
)
_step(
    "dim",
    ("attrs", "staging"),
    """
    select a.*, first_date, last_date, trading_days, avg_daily_volume
    from attrs a left join (
      select ticker, min(date) first_date, max(date) last_date, count(date) trading_days,
             round(avg(volume), 0) avg_daily_volume
      from staging group by ticker) s on a.ticker = s.ticker
    """,
)
# One exchange delivers its histories again, cut short: their bars before 1999 replace all they had.
_step(
    "new_raw",
    ("raw", "attrs"),
    """
    select raw.* from raw join attrs using (ticker) where exchange <> 'LSE' or date < date '1999-01-01'
    """,
)
_panel_steps("new_")
_step("new_dim", ("attrs", "new_staging"), STEPS["dim"][1].replace("staging", "new_staging"))


def r(expr: str, digits: int, name: str | None = None) -> str:
    """Rounded expression; adding zero turns -0.0 into 0.0."""
    return f"round({expr}, {digits}) + cast(0 as double) as {name or expr}"
