"""What the optimiser makes of the plans: exchanges, joins, pruning."""

from __future__ import annotations

import re

import pytest

from panelcheck import market
from panelstats.operators.quality import dedup, filter_abs
from panelstats.plans import distribution, reports, views
from panelstats.plans.staging import build_staging
from panelstats.plans.star import rolling_fact
from panelstats.spec import PanelSpec

SPEC = PanelSpec()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)\(", plan)


@pytest.fixture
def no_broadcast(spark):
    """As if every table were too large to broadcast."""
    before = {
        c: spark.conf.get(c)
        for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
        if spark.conf.get(c, None) is not None
    }
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for c, v in before.items():
        spark.conf.set(c, v)


def test_dedup_combines_before_its_exchange(zones, plan_of):
    plan = plan_of(dedup(zones.raw, SPEC.grid, latest=SPEC.version))
    assert exchanges(plan) == ["hashpartitioning"]
    assert plan.index("partial_max") > plan.index("Exchange")  # printed root first


def test_staging_needs_one_exchange_for_copies_and_one_for_series(zones, plan_of):
    assert exchanges(plan_of(build_staging(zones.raw))) == ["hashpartitioning", "hashpartitioning"]


def test_rolling_fact_sorts_once(zones, plan_of):
    plan = plan_of(rolling_fact(zones.staging))
    assert exchanges(plan) == [] and plan.count("Sort [") == 1
    unbucketed = plan_of(rolling_fact(zones.spark.read.parquet(zones.warehouse.path("staging"))))
    assert exchanges(unbucketed) == ["hashpartitioning"] and unbucketed.count("Sort [") == 1


def test_small_dimension_is_broadcast_by_its_size(zones, plan_of):
    plan = plan_of(views.normalized_prices(zones.prices, zones.dim, ordered=False))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_large_tables_join_without_an_exchange(zones, plan_of, no_broadcast):
    for view in (
        views.normalized_prices(zones.prices, zones.dim, ordered=False),
        views.risk_return(zones.prices, zones.rolling, zones.dim, ordered=False),
        views.volatility_heatmap(zones.prices, zones.rolling, zones.dim, ordered=False),
        views.drawdown_analysis(zones.prices, zones.rolling, zones.dim, ordered=False),
    ):
        plan = plan_of(view)
        assert exchanges(plan) == [] and "Broadcast" not in plan


def test_category_views_exchange_only_partial_results(zones, plan_of, no_broadcast):
    for view in (
        views.category_performance(zones.prices, zones.dim, ordered=False),
        views.category_volatility(zones.rolling, zones.dim, ordered=False),
    ):
        plan = plan_of(view)
        assert exchanges(plan) == ["hashpartitioning"]
        below = plan[plan.index("Exchange") :]
        assert "partial_" in below.splitlines()[1]


def test_top_k_takes_without_a_full_sort(zones, plan_of):
    risk = views.risk_return(zones.prices, zones.rolling, zones.dim, ordered=False)
    for report in (reports.top_total_return(risk), reports.top_return_to_risk(risk)):
        plan = plan_of(report)
        assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_sort_under_an_aggregate_disappears(zones, plan_of):
    view = views.normalized_prices(zones.prices, zones.dim, ordered=True)
    plan = plan_of(reports.return_histogram(view))
    assert plan.count("rangepartitioning") == 1  # that of the report itself


def test_anomaly_filter_and_columns_reach_the_scan(zones, plan_of):
    plan = plan_of(filter_abs(zones.staging, "return_zscore").select("ticker", "return_zscore"))
    pushed = re.search(r"PushedFilters: (.*?)ReadSchema", plan, re.S).group(1)
    assert "GreaterThan(return_zscore,2.5)" in pushed and "LessThan(return_zscore,-2.5)" in pushed
    assert "ReadSchema: struct<ticker:string,return_zscore:double>" in plan


def test_one_series_reads_one_bucket(zones, plan_of):
    one = zones.prices.filter("ticker = 'SUP000000003'")
    assert "EqualTo(ticker,SUP000000003)" in plan_of(one)
    assert one.rdd.getNumPartitions() == 1 < zones.prices.rdd.getNumPartitions()


def test_bars_are_summed_before_they_travel(spark, zones, plan_of):
    plan = plan_of(market.raw_bars(spark, zones.sf_dir))
    assert exchanges(plan) == ["hashpartitioning", "hashpartitioning"]
    assert "partial_sum" in plan


def test_no_query_multiplies_rows(zones, plan_of):
    from panelcheck.queries import QUERIES

    for name, (build, _) in QUERIES.items():
        plan = plan_of(build(zones))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "Python" not in plan and "Pandas" not in plan, name


def test_correlation_is_placed_by_key_and_day(spark, zones, plan_of, no_broadcast):
    """One series is in all pairs: its rows still go to many tasks, on either side."""
    keys = [r.ticker for r in zones.dim.select("ticker").collect()]
    pairs = [(k, keys[0]) for k in keys[1:]] + [(keys[0], k) for k in keys[1:]]
    frame = spark.createDataFrame(pairs, "key_a string, key_b string")
    got = distribution.return_correlation(zones.prices, frame)
    plan = plan_of(got)
    assert re.search(r"hashpartitioning\(key_b#\d+, date#\d+", plan)
    assert re.search(r"hashpartitioning\(key_a#\d+, _slice#\d+", plan)
    same = {(r.key_a, r.key_b): (r.days, round(r.correlation, 9)) for r in got.collect()}
    assert len(same) == len(pairs) and all(same[a, b] == same[b, a] for a, b in same)
