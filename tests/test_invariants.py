"""Properties that hold for every panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.plans import reports, views


def test_one_row_per_key_and_day(zones):
    for table in (zones.staging, zones.prices, zones.rolling, zones.anomalies):
        assert table.groupBy("ticker", "date").count().filter("count > 1").isEmpty()


def test_every_series_starts_at_the_base(zones):
    first = zones.prices.groupBy("ticker").agg(F.min_by("close_norm", "date").alias("base"))
    assert first.filter("abs(base - 100) > 1e-9").isEmpty()


def test_zscores_are_standardised(zones):
    scores = ("return_zscore", "volume_zscore")
    moments = zones.staging.groupBy("ticker").agg(
        *[F.avg(c).alias(f"m_{c}") for c in scores], *[F.stddev_samp(c).alias(f"s_{c}") for c in scores]
    )
    off = " or ".join(f"abs(m_{c}) > 1e-9 or abs(s_{c} - 1) > 1e-9" for c in scores)
    assert moments.filter(off).isEmpty()


def test_drawdown_is_never_positive(zones):
    assert zones.rolling.filter("drawdown > 0 or drawdown is null").isEmpty()


def test_histogram_counts_every_return(zones):
    view = views.normalized_prices(zones.prices, zones.dim, ordered=False)
    histogram = reports.return_histogram(view)
    total = zones.prices.filter("daily_return is not null").count()
    assert histogram.agg(F.sum("frequency")).first()[0] == total
    assert reports.category_histogram(histogram).agg(F.sum("frequency")).first()[0] == total


def test_top_five_head_the_risk_view(zones):
    risk = views.risk_return(zones.prices, zones.rolling, zones.dim)
    top = [r.ticker for r in reports.top_total_return(risk).collect()]
    assert top == [r.ticker for r in risk.limit(5).collect()]


def test_views_keep_their_order(zones):
    days = [(r.category, r.date) for r in views.category_performance(zones.prices, zones.dim).collect()]
    assert days == sorted(days)
    detail = views.anomaly_detail(zones.anomalies, zones.dim).select("date", "return_zscore").collect()
    keys = [(-r.date.toordinal(), -abs(r.return_zscore)) for r in detail]
    assert keys == sorted(keys)
