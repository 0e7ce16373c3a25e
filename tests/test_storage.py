"""Zones, sinks, ingestion and its reports."""

from __future__ import annotations

import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F

from panelcheck import market
from panelstats.plans.staging import build_staging
from panelstats.plans.star import rolling_fact
from panelstats.plans.warehouse import TABLES, Warehouse, publish
from panelstats.sources import ingest, metrics, panel, sinks
from panelstats.spec import PanelSpec
from panelstats.streaming.landing import ingest_landed

from test_micro import BAR, DAY0, bars, run

SPEC = PanelSpec()


def content(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_text_keys_survive_the_directory_name(spark, tmp_path):
    raw = bars(spark, ("007", 0, 1.0, 1, "1"), ("1e5", 0, 2.0, 1, "1"))
    path = str(tmp_path / "raw")
    sinks.replace_keys(raw, path)
    assert content(panel.read_panel(spark, path), "ticker", "close") == [("007", 1.0), ("1e5", 2.0)]
    given = panel.read_panel(spark, path, schema=SPEC.bar_schema())
    assert content(given, "ticker", "close") == [("007", 1.0), ("1e5", 2.0)]


def test_footers_are_merged(spark, tmp_path):
    path = str(tmp_path / "raw")
    sinks.replace_keys(bars(spark, ("A", 0, 1.0, 1, "1")).drop("volume"), path)
    sinks.replace_keys(bars(spark, ("B", 0, 2.0, 5, "1")), path)
    assert content(panel.read_panel(spark, path).fillna(-1), "ticker", "volume") == [("A", -1), ("B", 5)]


@pytest.mark.parametrize("buckets", [None, 1, 4])
def test_arriving_keys_are_replaced_whole_and_others_kept(spark, tmp_path, buckets):
    path = str(tmp_path / "raw")
    old = bars(spark, *[(k, d, 1.0, 1, "1") for k in "ABCDE" for d in range(3)])
    sinks.replace_keys(old, path, SPEC, buckets)
    sinks.replace_keys(bars(spark, ("B", 7, 9.0, 1, "2"), ("F", 0, 9.0, 1, "2")), path, SPEC, buckets)
    got = content(spark.read.parquet(path), "ticker", "close")
    assert got == sorted([(k, 1.0) for k in "ACDE" for _ in range(3)] + [("B", 9.0), ("F", 9.0)])


@pytest.mark.parametrize("layout", ["key", "bucket"])
def test_both_jobs_and_all_views(spark, zones, tmp_path, layout):
    house = Warehouse(spark, str(tmp_path / layout), layout=layout)
    observer = metrics.StageObserver()
    staging = house.write_staging(zones.raw, observer)
    star = house.write_star(staging, zones.attrs)
    assert set(star) == set(TABLES)
    seen = observer.report()
    wanted = {r.metric: r.value for r in metrics.staging_metrics(zones.raw, zones.staging).collect()}
    assert seen["raw"]["rows"] == wanted["raw_rows"]
    assert seen["raw"]["rows"] - seen["deduplicated"]["rows"] == wanted["duplicates_removed"]
    assert seen["staging"] == {
        "rows": wanted["rows_after_fill"], "is_volume_outlier": wanted["volume_outliers"]
    }
    names = publish(star, ordered=False)
    assert len(names) == 8
    for name in names:
        assert spark.sql(f"select * from {name}").count() > 0
    assert star["fact_rolling"].count() == zones.rolling.count()
    house.write_prices(staging)  # a rerun overwrites
    assert spark.read.parquet(house.path("fact_prices")).count() == zones.prices.count()


def test_hot_key_is_written_by_several_tasks(spark, tmp_path):
    """Half of the rows belong to one key; its directory still is not the work of one task."""
    hot = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 20)).alias("ticker"),
        F.date_add(F.lit("1900-01-01"), (F.col("id") % 40_000).cast("int")).alias("date"),
        F.rand(1).alias("close"),
    )
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        back = sinks.write_fact(hot, str(tmp_path / "fact"), layout="key")
        sinks.replace_keys(hot, str(tmp_path / "raw"), buckets=4)
    finally:
        spark.conf.unset(size)
    assert back.count() == spark.read.parquet(str(tmp_path / "raw")).count() == 200_000
    files = back.select("ticker", F.input_file_name().alias("file")).distinct().groupBy("ticker").count()
    parts = {r.ticker: r["count"] for r in files.collect()}
    assert parts["hot"] > 2 and min(parts.values()) == 1


def test_unknown_layout_and_missing_table_name(spark, tmp_path):
    df = run(spark, [1.0])
    with pytest.raises(ValueError):
        sinks.write_fact(df, str(tmp_path / "x"), layout="heap")
    with pytest.raises(ValueError):
        sinks.write_fact(df, str(tmp_path / "x"), layout="bucket")


def test_bucketed_zone_reads_back_by_path_too(spark, zones):
    plain = panel.read_zone(spark, zones.warehouse.path("fact_prices"))
    assert plain.exceptAll(zones.prices).isEmpty() and zones.prices.exceptAll(plain).isEmpty()


def test_dimension_from_rows_and_csv(spark, tmp_path):
    rows = [("XMPL", "An example", "P", "Made up", "None", "USD", "NYSE")]
    dim = panel.dim_from_rows(spark, rows)
    path = str(tmp_path / "csv")
    sinks.export_csv(dim, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == list(panel.DIM_COLUMNS) and [tuple(r) for r in back.collect()] == rows
    assert sinks.write_dim(dim, str(tmp_path / "dim")).collect() == dim.collect()


def test_wall_time_of_the_exchange_is_kept(spark):
    df = spark.sql(
        "select timestamp'2024-07-01 23:30:00.123789Z' as `Date`, 1.0D as `Open`, 5L as `Volume`, "
        "0.0D as `Stock Splits`, 'L' as `Ticker`"
    )
    out = panel.normalize_bars(df, SPEC, dt.date(2024, 7, 2), exchange_tz="Europe/London")
    row = out.collect()[0]
    assert row.date == dt.datetime(2024, 7, 2, 0, 30, 0, 123000)
    assert out.columns == ["date", "open", "volume", "ticker", "ingestion_date"]
    assert row.ingestion_date == "2024-07-02"


def test_history_is_half_open(spark):
    df = run(spark, [1.0, 2.0, 3.0])
    kept = panel.clip_history(df, DAY0 + dt.timedelta(1), DAY0 + dt.timedelta(2))
    assert [r.close for r in kept.collect()] == [2.0]


def test_summary_is_the_same_at_every_size(spark):
    registry = spark.createDataFrame([("A",), ("B",), ("C",)], "ticker string")
    batch = bars(spark, ("A", 0, 1.0, 1, "1"), ("C", 0, 1.0, 1, "1"))
    row = ingest.ingest_summary(batch, registry, "2024-01-02").collect()[0]
    assert (row.status_code, row.n_processed, row.n_failed) == (200, 2, 1)
    assert json.loads(row.body) == {"run_date": "2024-01-02", "n_processed": 2, "n_failed": 1}
    nothing = ingest.ingest_summary(batch.limit(0), registry, "2024-01-02").collect()[0]
    assert nothing.status_code == 500 and json.loads(nothing.body)["n_processed"] == 0
    status = {r.ticker: (r.rows, r.status) for r in ingest.ingest_status(batch, registry).collect()}
    assert status == {"A": (1, "processed"), "B": (0, "failed"), "C": (1, "processed")}


def test_stored_columns_survive_and_new_ones_come_in(spark, tmp_path):
    path = str(tmp_path / "raw")
    sinks.replace_keys(bars(spark, *[(k, 0, 1.0, 5, "1") for k in "ABCDE"]), path, SPEC, 2)
    sinks.replace_keys(bars(spark, ("B", 0, 2.0, 6, "2")).drop("volume"), path, SPEC, 2)
    wider = bars(spark, ("C", 0, 3.0, 7, "3")).withColumn("note", F.lit("new"))
    sinks.replace_keys(wider, path, SPEC, 2)
    got = spark.read.option("mergeSchema", True).parquet(path).fillna(-1)
    assert content(got, "ticker", "volume", "note") == [("A", 5, None), ("B", -1, None), ("C", 7, "new"), ("D", 5, None), ("E", 5, None)]
    with pytest.raises(ValueError, match="other types: volume"):
        sinks.replace_keys(bars(spark, ("A", 0, 1.0, 1, "1")).withColumn("volume", F.lit("x")), path, SPEC, 2)


def test_bucket_count_is_a_property_of_the_zone(spark, tmp_path):
    path = str(tmp_path / "raw")
    first = bars(spark, *[(k, 0, 1.0, 1, "1") for k in "ABCDE"])
    sinks.replace_keys(first, path, SPEC, 4)
    with pytest.raises(ValueError, match="has 4 buckets, not 3"):
        sinks.replace_keys(first, path, SPEC, 3)
    assert sinks.stored_buckets(spark, path) == 4 and spark.read.parquet(path).count() == 5


def test_only_touched_directories_are_read_and_written(spark, tmp_path):
    path = tmp_path / "raw"
    sinks.replace_keys(bars(spark, *[(f"k{i}", 0, 1.0, 1, "1") for i in range(40)]), str(path), SPEC, 8)
    before = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    for f in path.rglob("*.parquet"):  # whatever else is read would fail
        if f.parent.name != "key_bucket=" + str(spark.sql("select pmod(hash('k3'), 8)").first()[0]):
            f.write_bytes(b"unreadable")
    sinks.replace_keys(bars(spark, ("k3", 0, 9.0, 1, "2")), str(path), SPEC, 8)
    assert sum(f.exists() for f in before) == len(before) - 1


def test_one_batch_and_two_give_the_same_history(spark, tmp_path):
    """The newest file of a key replaces what older ones have of it."""
    old = bars(spark, *[("A", d, 1.0, 1, "x") for d in range(3)], ("B", 0, 5.0, 1, "x")).coalesce(1)
    new = bars(spark, *[("A", d, 2.0, 1, "x") for d in range(2)]).coalesce(1)
    found = []
    for between in (False, True):
        landing, raw, state = (str(tmp_path / f"{between}-{d}") for d in ("landing", "raw", "state"))
        take = lambda: ingest_landed(spark, landing, raw, state, old.schema, "2024-01-02", buckets=3)  # noqa: B023, E731
        old.write.mode("append").parquet(landing)
        if between:
            take()
        time.sleep(1.1)
        new.write.mode("append").parquet(landing)
        take()
        found.append(content(panel.read_panel(spark, raw), "ticker", "date", "close"))
    assert found[0] == found[1] and [(t, c) for t, _, c in found[0]] == [("A", 2.0), ("A", 2.0), ("B", 5.0)]


def test_every_instrument_has_its_own_zone(spark):
    names = spark.createDataFrame([("L", "London", "Europe/London"), ("N", "York", "America/New_York"), ("X", "none", None)], "ticker string, etf_name string, tz string")
    df = spark.sql(
        "select timestamp'2024-06-30 23:00:00Z' as Date, 1.0D as Close, 'L' as Ticker union all "
        "select timestamp'2024-07-01 04:00:00Z', 2.0D, 'N' union all select timestamp'2024-07-01 00:00:00Z', 3.0D, 'X'"
    )
    out = panel.normalize_bars(df, SPEC, names=names, zone="tz")
    assert {r.ticker: r.date for r in out.collect()} == {k: dt.datetime(2024, 7, 1) for k in "LNX"}


def test_legacy_dates_need_their_mode(spark, tmp_path):
    """A day before the Gregorian calendar, written as old writers did: as the same number of days."""
    path = str(tmp_path / "raw" / "ticker=A")
    conf = "spark.sql.parquet.datetimeRebaseModeInWrite"
    spark.conf.set(conf, "LEGACY")
    try:
        spark.sql("select date'1500-03-01' as date, 1.0D as close").write.parquet(path)
    finally:
        spark.conf.unset(conf)
    bare = spark.sql("select date'1500-03-10' as date, 1.0D as close")
    bare.write.option("datetimeRebaseMode", "CORRECTED").parquet(str(tmp_path / "plain" / "ticker=A"))
    legacy = panel.read_panel(spark, str(tmp_path / "raw"), rebase="LEGACY").first().date
    assert legacy == dt.date(1500, 3, 1)
    assert panel.read_panel(spark, str(tmp_path / "plain")).first().date == dt.date(1500, 3, 10)


def test_reopened_warehouse_needs_no_exchange(spark, zones, tmp_path, plan_of):
    root = str(tmp_path / "a-b")
    house = Warehouse(spark, root, buckets=4)
    house.write_star(house.write_staging(zones.raw), zones.attrs)
    for zone in ("staging", *TABLES):
        spark.sql(f"drop table {house.table(zone)}")  # as a new catalog, which knows nothing
    again = Warehouse(spark, root)
    stored = again.open()
    assert set(stored) == {"staging", *TABLES} and again.bucket_count() == 4
    assert "Exchange" not in plan_of(rolling_fact(stored["staging"]))
    assert stored["fact_rolling"].count() == zones.rolling.count()
    assert Warehouse(spark, str(tmp_path / "a_b")).table("staging") != house.table("staging")
    with pytest.raises(ValueError, match="has 4 buckets"):
        Warehouse(spark, root, buckets=5).bucket_count()


def test_unbounded_series_are_refused(spark, tmp_path):
    ticks = PanelSpec(grain="instant")
    with pytest.raises(ValueError, match="bounded length"):
        Warehouse(spark, str(tmp_path / "x"), ticks)
    with pytest.raises(ValueError, match="bounded length"):
        rolling_fact(run(spark, [1.0]), ticks)


def test_schema_report(spark):
    assert metrics.schema_report(run(spark, [1.0]).select("date", "close")) == [
        ("date", "date", True), ("close", "double", True)
    ]


def test_landed_files_are_taken_once(spark, tmp_path):
    landing, raw, state = (str(tmp_path / d) for d in ("landing", "raw", "state"))
    schema = spark.createDataFrame([], BAR).schema

    def take(asof):
        ingest_landed(spark, landing, raw, state, schema, asof)
        return content(panel.read_panel(spark, raw), "ticker", "close", "ingestion_date")

    bars(spark, ("A", 0, 1.0, 1, "x"), ("B", 0, 2.0, 1, "x")).coalesce(1).write.mode("append").parquet(landing)
    assert take("2024-01-02") == [("A", 1.0, "2024-01-02"), ("B", 2.0, "2024-01-02")]
    bars(spark, ("B", 0, 3.0, 1, "x"), ("B", 1, 4.0, 1, "x")).coalesce(1).write.mode("append").parquet(landing)
    later = [("A", 1.0, "2024-01-02"), ("B", 3.0, "2024-01-03"), ("B", 4.0, "2024-01-03")]
    assert take("2024-01-03") == later
    assert take("2024-01-04") == later


def test_last_landed_file_of_a_batch_wins(spark, tmp_path):
    landing, raw, state = (str(tmp_path / d) for d in ("landing", "raw", "state"))
    frames = bars(spark, ("A", 0, 9.0, 1, "x")), bars(spark, ("A", 0, 1.0, 1, "x"), ("A", 1, 2.0, 1, "x"))
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(landing)
        time.sleep(1.1)
    ingest_landed(spark, landing, raw, state, frames[0].schema, "2024-01-02", buckets=3)
    assert content(panel.read_panel(spark, raw), "ticker", "close") == [("A", 1.0), ("A", 2.0)]


def test_hot_copies_do_not_change_the_result(spark, zones):
    """A third of all raw rows are copies of one bar."""
    one = zones.raw.filter("close is not null").orderBy("ticker", "date").limit(1)
    n = zones.raw.count() // 2
    copies = one.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(n)))).drop("_c")
    want = build_staging(zones.raw)
    got = build_staging(zones.raw.unionByName(copies))
    assert got.count() == want.count()
    cols = ["ticker", "date", "close", "volume", "is_volume_outlier"]
    assert got.select(*cols).exceptAll(want.select(*cols)).isEmpty()


def test_fixture_walk_has_every_case(spark, zones):
    raw = market.raw_bars(spark, zones.sf_dir)
    assert raw.filter("close is null").count() > 0
    assert raw.count() > raw.dropDuplicates(["ticker", "date"]).count()
    assert zones.anomalies.select("anomaly_severity").distinct().count() == 3
