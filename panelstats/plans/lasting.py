"""The eight views as stored SQL over registered tables, for sessions to come.

``publish`` in ``warehouse`` registers views that end with their session.  These are entries of the catalog: any
session that reaches it reads them by name, and they last as long as the catalog does.
"""

from __future__ import annotations

from ..spec import PanelSpec
from .warehouse import TABLES, Warehouse


def view_texts(tables: dict[str, str], spec: PanelSpec = PanelSpec()) -> dict[str, str]:
    """Name to select statement of each view, over the tables of the star by name; unordered."""
    dim, prices, rolling, anomalies = (tables[t] for t in TABLES)
    key, ts, name, category, provider = (f"`{c}`" for c in (spec.key, spec.ts, spec.name, spec.category, spec.provider))
    close, volume, vol = (f"`{c}`" for c in (spec.close, spec.volume, spec.volatility))
    trend, label = spec.trend_sma, spec.trend_sma.replace("_", "")
    smas = ", ".join(f"r.sma_{n}" for n in spec.sma_frames)
    month = "date_format({}, 'yyyy-MM')".format
    both = f"{prices} p join {rolling} r on p.{key} = r.{key} and p.{ts} = r.{ts}"
    apart = f"abs(p.{close} - r.{trend}) > abs(r.{trend}) * {spec.trend_tolerance:e}D"
    return {
        "v_prices_normalized": f"""
            select p.{ts}, p.{key}, d.{name}, d.{provider}, d.{category}, p.{close}, p.close_norm, p.cumulative_return,
                   p.daily_return, p.day_direction, p.{volume}
            from {prices} p join {dim} d on p.{key} = d.{key}""",
        "v_category_performance": f"""
            select d.{category}, p.{ts}, round(avg(p.close_norm), 2) avg_close_norm, round(avg(p.daily_return) * 100, 4) avg_daily_return_pct,
                   round(avg(p.cumulative_return) * 100, 2) avg_cumulative_return_pct, count(*) etf_count, {month(f"p.{ts}")} year_month
            from {prices} p join {dim} d on p.{key} = d.{key} group by d.{category}, p.{ts}""",
        "v_category_volatility": f"""
            select d.{category}, year_month, round(try_divide(sum(vol_sum), sum(vol_n)), 4) avg_volatility,
                   round(min(worst) * 100, 2) worst_drawdown_pct, count(*) etf_count
            from (select {key}, {month(ts)} year_month, sum({vol}) vol_sum, count({vol}) vol_n, min(drawdown) worst
                  from {rolling} group by {key}, {month(ts)}) s
            join {dim} d on s.{key} = d.{key} group by d.{category}, year_month""",
        "v_risk_return": f"""
            select s.{key}, d.{name}, d.{category}, d.{provider}, round(gain * 100, 2) total_return_pct, round(risk * 100, 2) avg_volatility_pct,
                   round(try_divide(gain, risk), 2) return_to_risk_ratio, round(worst * 100, 2) max_drawdown_pct, s.trading_days
            from (select p.{key}, max(p.cumulative_return) gain, avg(r.{vol}) risk, min(r.drawdown) worst, count(*) trading_days
                  from {both} group by p.{key}) s
            join {dim} d on s.{key} = d.{key}""",
        "v_returns_daily": f"""
            select {ts}, {key}, daily_return, close_norm, cumulative_return from {prices} where daily_return is not null""",
        "v_volatility_heatmap": f"""
            select s.*, d.{name}, d.{category}
            from (select p.{key}, {month(f"p.{ts}")} year_month, year(p.{ts}) year, month(p.{ts}) month, round(avg(r.{vol}), 4) avg_volatility,
                         round(avg(p.daily_return), 4) avg_daily_return,
                         round(try_divide(max(p.close_norm) - min(p.close_norm), min(p.close_norm)), 4) monthly_range
                  from {both} group by p.{key}, {month(f"p.{ts}")}, year(p.{ts}), month(p.{ts})) s
            join {dim} d on s.{key} = d.{key}""",
        "v_drawdown_analysis": f"""
            select p.{ts}, p.{key}, d.{name}, d.{category}, round(r.drawdown * 100, 2) drawdown_pct, round(r.{vol}, 4) volatility_ann, {smas},
                   case when {apart} and p.{close} > r.{trend} then 'above_{label}'
                        when {apart} and p.{close} < r.{trend} then 'below_{label}' else 'at_{label}' end trend_signal
            from {both} join {dim} d on p.{key} = d.{key}""",
        "v_anomalies_detail": f"""
            select a.{ts}, a.{key}, d.{name}, d.{provider}, d.{category}, round(a.daily_return * 100, 2) daily_return_pct,
                   round(a.return_zscore, 2) return_zscore, a.anomaly_type, a.anomaly_severity, a.{volume},
                   round(a.volume_zscore, 2) volume_zscore,
                   coalesce(abs(a.volume_zscore) > {spec.high_volume_z:e}D, false) high_volume_anomaly
            from {anomalies} a join {dim} d on a.{key} = d.{key}""",
    }


def create_views(house: Warehouse, database: str | None = None) -> list[str]:
    """Store the views in the catalog (``database``, or the current one); returns their names.

    The warehouse must have its tables registered: it does after ``write_star`` or ``open`` with a bucketed layout.
    A view of the same name is replaced; it belongs to the tables of the warehouse that stored it last.
    """
    if house.layout not in ("bucket", "hashed"):
        raise ValueError("stored views need registered tables: a bucketed layout")
    own = f"`{database}`." if database else ""
    for name, text in view_texts({t: house.table(t) for t in TABLES}, house.spec).items():
        house.spark.sql(f"create or replace view {own}{name} as {text}")
    return [f"{own}{name}" for name in view_texts({t: t for t in TABLES}, house.spec)]
