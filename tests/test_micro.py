"""Hand-computed frames for single operators."""

from __future__ import annotations

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from panelstats.functions import scalars as fn
from panelstats.operators import ordering, quality, series
from panelstats.operators.calendar import densify
from panelstats.plans import views
from panelstats.plans.staging import build_staging
from panelstats.plans.star import anomaly_fact, build_dim, price_fact, rolling_fact
from panelstats.spec import INSTANT, PanelSpec

BAR = (
    "ticker string, date date, open double, high double, low double, close double, volume long, "
    "etf_name string, ingestion_date string"
)
DAY0 = dt.date(2024, 1, 1)


def bars(spark, *rows):
    """(key, day number, close, volume, version) to whole bars."""
    return spark.createDataFrame(
        [(k, DAY0 + dt.timedelta(d), c, c, c, c, v, k, version) for k, d, c, v, version in rows], BAR
    )


def run(spark, closes, key="A", volumes=None):
    volumes = volumes or [10 + i for i in range(len(closes))]
    return bars(spark, *[(key, i, c, v, "1") for i, (c, v) in enumerate(zip(closes, volumes))])


def by_day(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.orderBy("ticker", "date").select(*cols).collect()]


def test_single_row(spark):
    staging = build_staging(run(spark, [50.0]))
    row = staging.collect()[0]
    assert (row.daily_return, row.return_zscore, row.volume_zscore) == (None, None, None)
    assert row.is_volume_outlier is None and row.close_norm == 100.0
    rolling = rolling_fact(staging).collect()[0]
    assert (rolling.sma_20, rolling.sma_252, rolling.drawdown) == (50.0, 50.0, 0.0)
    assert rolling.volatility_30_annualized is None
    assert price_fact(staging).collect()[0].day_direction == fn.FLAT


def test_constant_series_has_no_zscore(spark):
    staging = build_staging(run(spark, [50.0] * 5, volumes=[7] * 5))
    assert set(by_day(staging, "return_zscore")) == {None}
    assert set(by_day(staging, "volume_zscore")) == {None}
    assert anomaly_fact(staging).count() == 0
    assert set(by_day(price_fact(staging), "day_direction")) == {fn.FLAT}


def test_leading_gap_is_dropped_and_inner_gap_filled(spark):
    raw = bars(
        spark,
        ("A", 0, None, None, "1"), ("A", 1, None, None, "1"), ("A", 2, 10.0, 5, "1"), ("A", 3, None, None, "1"),
        ("B", 0, None, None, "1"), ("B", 1, None, None, "1"),
    )
    staging = build_staging(raw)
    assert by_day(staging, "ticker", "close", "volume", "daily_return") == [
        ("A", 10.0, 5, None), ("A", 10.0, 5, 0.0)
    ]


def test_volume_alone_may_stay_null(spark):
    staging = build_staging(bars(spark, ("A", 0, 10.0, None, "1"), ("A", 1, 11.0, 3, "1")))
    assert by_day(staging, "volume", "is_volume_outlier") == [(None, None), (3, None)]


def test_newest_version_survives_whole(spark):
    raw = bars(
        spark, ("A", 0, 10.0, 1, "2024-01-01"), ("A", 0, None, 2, "2024-01-02"), ("A", 0, 99.0, 9, None)
    )
    (row,) = quality.dedup(raw, ["date", "ticker"], latest="ingestion_date").collect()
    assert (row.close, row.volume, row.ingestion_date) == (None, 2, "2024-01-02")


def test_dedup_does_not_depend_on_row_order(spark):
    raw = bars(spark, *[("A", 0, float(c), 1, "1") for c in (3, 1, 2)])
    for shuffled in (raw, raw.orderBy(F.col("close")), raw.repartition(3, "close")):
        assert quality.dedup(shuffled, ["date", "ticker"], "ingestion_date").collect()[0].close == 3.0


def test_dedup_of_map_columns(spark):
    df = spark.createDataFrame([("A", 1, {"x": 1}), ("A", 2, {"x": 2})], "k string, v int, m map<string,int>")
    assert quality.dedup(df, ["k"], latest="v").collect()[0].m == {"x": 2}
    assert df.select("k").transform(quality.dedup, ["k"]).count() == 1


def test_zero_price_does_not_fail(spark):
    staging = build_staging(run(spark, [0.0, 5.0, 0.0]))
    assert by_day(staging, "daily_return", "close_norm") == [(None, None), (None, None), (-1.0, None)]
    assert by_day(rolling_fact(staging), "drawdown") == [None, 0.0, -1.0]


def test_bad_casts_become_null(spark):
    df = spark.createDataFrame([("n/a", "12", "2024-01-05", 7)], "close string, volume string, date string, ticker int")
    row = quality.cast_bars(df).collect()[0]
    assert (row.close, row.volume, row.date, row.ticker) == (None, 12, dt.date(2024, 1, 5), "7")


@pytest.mark.parametrize("length", [25, 300])
def test_frames_against_plain_python(spark, length):
    closes = [100 + 10 * math.sin(i / 7) + i % 5 for i in range(length)]
    rolling = rolling_fact(build_staging(run(spark, closes)))
    returns = [None] + [b / a - 1 for a, b in zip(closes, closes[1:])]
    for i, row in enumerate(rolling.orderBy("date").collect()):
        for n, got in ((20, row.sma_20), (252, row.sma_252)):
            frame = closes[max(0, i - n + 1) : i + 1]
            assert got == pytest.approx(sum(frame) / len(frame), rel=1e-12)
        seen = [r for r in returns[max(0, i - 29) : i + 1] if r is not None]
        if len(seen) < 2:
            assert row.volatility_30_annualized is None
        else:
            want = statistics.stdev(seen) * math.sqrt(252)
            assert row.volatility_30_annualized == pytest.approx(want, rel=1e-9)
        peak = max(closes[: i + 1])
        assert row.drawdown == pytest.approx((closes[i] - peak) / peak, abs=1e-12)


@pytest.mark.parametrize("rows", [1, 2, 7, 63, 64, 67, 97, 100, 251, 252, 500])
def test_composed_frames_equal_sliding_ones(spark, rows):
    closes = [None if i % 11 == 3 else float(i * i % 97) for i in range(320)]
    df = run(spark, closes).select("ticker", "date", "close")
    got = by_day(series.moving_avg(df, "ticker", "date", "close", rows, "m"), "m")
    for i, value in enumerate(got):
        frame = [c for c in closes[max(0, i - rows + 1) : i + 1] if c is not None]
        assert value == (pytest.approx(sum(frame) / len(frame)) if frame else None)


def test_composed_frame_adds_no_columns_and_no_cancellation(spark):
    closes = [1e300] + [1e-5] * 299
    df = run(spark, closes).select("ticker", "date", "close")
    out = series.moving_avg(df, "ticker", "date", "close", 252)
    assert out.columns == ["ticker", "date", "close", "sma_252"]
    assert by_day(out, "sma_252")[-1] == pytest.approx(1e-5)


def test_severity_thresholds_are_strict(spark):
    zs = [2.5, -2.5, 2.6, 3.0, 3.1, 4.0, -4.1, None]
    df = spark.createDataFrame([(float(z) if z is not None else None,) for z in zs], "z double")
    kept = quality.filter_abs(df, "z", 2.5).select("z", fn.anomaly_severity("z").alias("s")).collect()
    assert {r.z: r.s for r in kept} == {
        2.6: fn.MODERATE, 3.0: fn.MODERATE, 3.1: fn.HIGH, 4.0: fn.HIGH, -4.1: fn.EXTREME
    }


def test_labels_of_zero_and_null(spark):
    df = spark.createDataFrame([(0.0,), (None,), (0.1,), (-0.1,)], "r double")
    assert [r[0] for r in df.select(fn.day_direction("r")).collect()] == [
        fn.FLAT, fn.FLAT, fn.POSITIVE, fn.NEGATIVE
    ]
    assert [r[0] for r in df.select(fn.anomaly_type("r")).collect()] == [
        fn.SPIKE_DOWN, fn.SPIKE_DOWN, fn.SPIKE_UP, fn.SPIKE_DOWN
    ]


def test_volume_flags_differ_on_null(spark):
    df = spark.createDataFrame([(None,), (2.0,), (-2.1,), (3.0,), (3.1,)], "z double")
    assert [r[0] for r in df.select(fn.high_volume_flag("z")).collect()] == [False, False, True, True, True]
    assert [r[0] for r in df.select(fn.volume_outlier_flag("z")).collect()] == [None, False, False, False, True]


def test_trend_signal_ignores_rounding_error(spark):
    df = spark.createDataFrame(
        [(501.38, 501.38 + 6e-14), (501.39, 501.38), (501.37, 501.38), (None, 1.0)], "c double, s double"
    )
    assert [r[0] for r in df.select(fn.trend_signal("c", "s")).collect()] == [
        "at_sma252", "above_sma252", "below_sma252", "at_sma252"
    ]


def test_top_k_breaks_ties_by_key_and_puts_nulls_last(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None), ("d", 1.0)], "k string, v double")
    assert [r.k for r in ordering.top_k(df, "v", 2, tie=["k"]).collect()] == ["a", "b"]
    assert [r.k for r in ordering.sorted_view(df, "-v", "k").collect()] == ["a", "b", "d", "c"]


def test_densify_adds_only_calendar_days_inside_gaps(spark):
    raw = bars(
        spark,
        ("A", 0, 1.0, 1, "1"), ("A", 5, 2.0, 1, "1"),
        ("B", 2, 1.0, 1, "1"), ("B", 3, 1.0, 1, "1"),
    ).select("ticker", "date", "close")
    full = densify(raw, "ticker", "date")
    got = {(r.ticker, (r.date - DAY0).days, r.close) for r in full.collect()}
    assert got == {("A", 0, 1.0), ("A", 2, None), ("A", 3, None), ("A", 5, 2.0), ("B", 2, 1.0), ("B", 3, 1.0)}
    filled = quality.forward_fill(full, "ticker", "date", ["close"])
    assert filled.filter("close is null").count() == 0


def test_densify_is_for_days(spark):
    df = run(spark, [1.0]).withColumn("date", F.col("date").cast("timestamp"))
    with pytest.raises(ValueError):
        densify(df, "ticker", "date")


def test_member_without_data_stays_in_the_dimension(spark):
    attrs = spark.createDataFrame([("A", "x"), ("Z", "y")], "ticker string, category string")
    dim = {r.ticker: r for r in build_dim(attrs, build_staging(run(spark, [1.0, 2.0]))).collect()}
    assert dim["A"].trading_days == 2 and dim["A"].avg_daily_volume == 11.0
    assert dim["Z"].category == "y" and dim["Z"].trading_days is None


def test_ratio_is_null_without_risk(spark):
    columns = "ticker string, etf_name string, category string, provider string"
    attrs = spark.createDataFrame([("A", "n", "c", "p")], columns)
    staging = build_staging(run(spark, [5.0] * 4))
    row = views.risk_return(price_fact(staging), rolling_fact(staging), attrs).collect()[0]
    assert (row.total_return_pct, row.avg_volatility_pct, row.return_to_risk_ratio) == (0.0, 0.0, None)
    with pytest.raises(ValueError):
        views.risk_return(price_fact(staging), rolling_fact(staging), attrs, total="sum")


def test_other_column_names_and_frames(spark):
    spec = PanelSpec(key="sensor", ts="day", close="level", sma_frames=(2, 3), vol_frame=4)
    raw = run(spark, [1.0, 2.0, 4.0]).withColumnsRenamed({"ticker": "sensor", "date": "day", "close": "level"})
    rolling = rolling_fact(build_staging(raw, spec), spec)
    assert rolling.columns == [
        "sensor", "day", "daily_return", "close_norm", "sma_2", "sma_3", "volatility_4_annualized", "drawdown"
    ]
    assert [r.sma_2 for r in rolling.orderBy("day").collect()] == [1.0, 1.5, 3.0]


def test_unbounded_series_are_refused_by_the_plain_plan(spark):
    with pytest.raises(ValueError, match="segments"):
        build_staging(run(spark, [1.0]), PanelSpec(grain=INSTANT))
    with pytest.raises(ValueError):
        PanelSpec(grain="hour")
