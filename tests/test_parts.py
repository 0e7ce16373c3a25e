"""Partitions by the size of the tables, and the right side of pairs."""

from __future__ import annotations

import datetime as dt

from panelcheck import zones as z
from panelstats import session
from panelstats.plans import distribution
from panelstats.sources import sinks


def test_partitions_grow_with_the_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(z, "LINES", 10)
    rows = spark.range(200).selectExpr("id % 20 l_suppkey", "date_add(date'1998-01-01', cast(id as int)) l_shipdate")
    rows = rows.selectExpr("*", "1.0D l_quantity", "0.04D l_discount", "cast(1 as int) l_linenumber")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    try:
        own = z.Zones(spark, str(tmp_path))
        assert own.parts == 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert own.staging.count() > 0 and own.warehouse.bucket_count() == session.exchange_partitions(spark) == 20
    finally:
        spark.conf.unset(session.INITIAL)


def test_first_arrivals_return_their_buckets(spark, tmp_path):
    rows = [(f"K{i % 9}", dt.date(2020, 1, 1 + i % 28), float(i)) for i in range(50)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double")
    want = sorted({r[0] for r in bars.select(sinks.bucket_of("ticker", 7)).collect()})
    for _ in range(2):  # the first call writes at once, the second stores what arrives
        assert sinks.replace_keys(bars, f"{tmp_path}/raw", buckets=7) == want
        assert spark.read.parquet(f"{tmp_path}/raw").count() == 50


def test_few_series_on_the_right_are_sent_to_the_left(spark, plan_of):
    rows = [(f"K{i:02d}", dt.date(2020, 1, 1) + dt.timedelta(d), float((i * d * d) % 17)) for i in range(12) for d in range(40)]
    returns = spark.createDataFrame(rows, "ticker string, date date, daily_return double")
    pairs = spark.createDataFrame([(f"K{i:02d}", "K01") for i in range(2, 12)] * 2, "key_a string, key_b string")
    got = distribution.return_correlation(returns, pairs)
    assert "hashpartitioning(key_b" not in plan_of(got)
    assert {r.key_a: r.days for r in got.collect()} == {f"K{i:02d}": 80 for i in range(2, 12)}
