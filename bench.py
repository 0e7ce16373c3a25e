"""Time the headline steps and queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores.  The two jobs are timed as they write
their tables, every query into a sink that discards its rows.  Each figure is the second of two runs
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from panelcheck import market
from panelcheck.compare import local_session
from panelcheck.queries import QUERIES
from panelcheck.zones import Zones
from panelstats.operators import segments
from panelstats.operators.series import moving_avg
from panelstats.plans.staging import build_staging
from panelstats.plans.star import rolling_fact
from panelstats.spec import PanelSpec

VIEWS_AND_REPORTS = [
    "v_prices_normalized",
    "v_category_performance",
    "v_category_volatility",
    "v_risk_return",
    "v_returns_daily",
    "v_volatility_heatmap",
    "v_drawdown_analysis",
    "v_anomalies_detail",
    "days_per_key",
    "coverage",
    "risk_return_by_category",
    "performance_over_time",
    "volatility_over_time",
    "top_total_return",
    "top_return_to_risk",
    "anomalies_by_category",
    "return_histogram",
]


#: Deliveries, pairs, calendars and long series, as registered.
OTHERS = ["replace_keys", "return_correlation", "correlated_pairs", "densify", "tick_rolling", "tick_star", "staging_metrics"]


def discard(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def second_run(step: Callable[[], object]) -> float:
    for _ in range(2):
        began = time.perf_counter()
        step()
        took = time.perf_counter() - began
    return round(took, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    z, spec = Zones(spark, sf_dir), PanelSpec()
    house, times = z.warehouse, {}

    times["bars_from_order_lines"] = second_run(lambda: discard(market.raw_bars(spark, sf_dir)))
    times["bars_and_staging"] = second_run(
        lambda: discard(build_staging(market.raw_bars(spark, sf_dir), spec))
    )
    times["staging"] = second_run(lambda: discard(build_staging(z.raw, spec)))
    times["write_staging"] = second_run(lambda: house.write_staging(z.raw))
    times["rolling"] = second_run(lambda: discard(rolling_fact(z.staging, spec)))
    times["moving_avg_252"] = second_run(
        lambda: discard(moving_avg(z.staging.select("ticker", "date", "close"), "ticker", "date", "close", 252))
    )
    times["write_star"] = second_run(lambda: house.write_star(z.staging, z.attrs))
    cut = segments.split(z.staging, spec, z.scratch("bench"))
    times["rolling_segmented"] = second_run(lambda: discard(segments.segmented_rolling(cut)))
    hashed, arriving = z.refreshed, market.delivery(z.raw, z.attrs)
    times["refresh"] = second_run(lambda: hashed.refresh(arriving, hashed.path("raw"), z.attrs))
    for name in (*VIEWS_AND_REPORTS, *OTHERS):
        build = QUERIES[name][0]
        times[name] = second_run(lambda: discard(build(z)))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "panel pipeline and analysis queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
