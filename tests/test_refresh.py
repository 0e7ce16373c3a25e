"""A delivery's way through all zones, summaries, and the schema stored with a zone."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelstats.plans import reports, summaries, views
from panelstats.plans.staging import build_staging
from panelstats.plans.star import anomaly_fact, build_dim, price_fact, rolling_fact
from panelstats.plans.warehouse import TABLES, ZONES, Warehouse
from panelstats.session import colocate_joins
from panelstats.sources import panel, schema, sinks
from panelstats.spec import PanelSpec

from test_micro import bars

SPEC = PanelSpec()


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def history(key, days, level, first=0):
    return [(key, d, level + (7 * d) % 11 + (40.0 if d == first + 25 else 0), 10 + d % 5, "1") for d in range(first, first + days)]


def attrs_of(spark, keys):
    return panel.dim_from_rows(spark, [(k, f"name {k}", "p", f"cat{i % 2}", "i", "EUR", "X") for i, k in enumerate(sorted(keys))])


def built(spark, tmp_path, given, buckets=4):
    house = Warehouse(spark, str(tmp_path / "house"), SPEC, layout="hashed", buckets=buckets)
    raw = house.path("raw")
    sinks.replace_keys(bars(spark, *given), raw, SPEC, buckets)
    attrs = attrs_of(spark, {g[0] for g in given} | {"NEW"})
    star = house.write_star(house.write_staging(panel.read_panel(spark, raw, SPEC).drop(sinks.BUCKET)), attrs)
    house.write_summaries(star)
    return house, raw, attrs


def check(house, raw, attrs):
    """Every zone equals what a full rebuild from the raw zone gives."""
    spark = house.spark
    staging = build_staging(spark.read.option("mergeSchema", True).parquet(raw).drop(sinks.BUCKET), SPEC).cache()
    want = {
        "staging": staging, "dim_etf": build_dim(attrs, staging, SPEC), "fact_prices": price_fact(staging, SPEC),
        "fact_rolling": rolling_fact(staging, SPEC), "fact_anomalies": anomaly_fact(staging, SPEC),
    }
    got = house.open()
    assert set(got) == set(ZONES)
    for zone, df in want.items():
        assert rows(got[zone]) == rows(df), zone
    for name, df in summaries.partials({t: want[t] for t in TABLES}, SPEC, house.bucket_count()).items():
        assert rows(house.summaries()[name]) == rows(df), name


KEYS = [f"K{i}" for i in range(12)]


def files_of(house):
    """Data files of all zones by bucket directory."""
    found = {}
    for f in Path(house.root).rglob("key_bucket=*/*.parquet"):
        found.setdefault(int(f.parent.name.removeprefix("key_bucket=")), {})[f] = f.stat().st_mtime_ns
    return found


def test_refresh_equals_a_full_rebuild(spark, tmp_path):
    house, raw, attrs = built(spark, tmp_path, [b for i, k in enumerate(KEYS) for b in history(k, 40, 100.0 + i)])
    check(house, raw, attrs)
    touched = house.refresh(bars(spark, *history("K3", 60, 50.0), *history("NEW", 35, 10.0)), raw, attrs)
    assert 0 < len(touched) <= 2
    check(house, raw, attrs)
    assert house.open()["fact_prices"].filter("ticker = 'K3'").count() == 60
    assert house.refresh(bars(spark, *history("K3", 60, 50.0)).limit(0), raw, attrs) == []


def test_buckets_that_empty_are_emptied_everywhere(spark, tmp_path):
    """A history without a single price leaves nothing in staging and facts; a calm one no anomalies."""
    house, raw, attrs = built(spark, tmp_path, [b for k in ("K1", "K2") for b in history(k, 40, 100.0)], buckets=64)
    assert house.open()["fact_anomalies"].count() > 0
    calm = [("K1", d, 100.0, 10, "2") for d in range(30)]
    unfilled = [("K2", d, None, 10, "2") for d in range(30)]
    assert len(house.refresh(bars(spark, *calm, *unfilled), raw, attrs)) == 2
    check(house, raw, attrs)
    star = house.open()
    assert star["fact_anomalies"].count() == 0 and {r.ticker for r in star["fact_prices"].collect()} == {"K1"}


def test_untouched_directories_are_neither_read_nor_written(spark, tmp_path):
    house, raw, attrs = built(spark, tmp_path, [b for i, k in enumerate(KEYS) for b in history(k, 30, 100.0 + i)], buckets=8)
    (mine,) = {r[0] for r in spark.sql("select pmod(hash('K5'), 8)").collect()}
    before = files_of(house)
    assert len(before) > 3
    for b, files in before.items():
        if b != mine:
            for f in files:  # whatever reads them fails
                f.write_bytes(b"unreadable")
    broken = files_of(house)
    assert house.refresh(bars(spark, *history("K5", 45, 77.0)), raw, attrs) == [mine]
    after = files_of(house)
    for b in before:
        assert (after[b] == broken[b]) == (b != mine)
    assert not set(after[mine]) & set(before[mine])


def test_hashed_zones_join_without_an_exchange(spark, tmp_path, plan_of):
    house, _, _ = built(colocate_joins(spark), tmp_path, [b for i, k in enumerate(KEYS) for b in history(k, 30, 100.0 + i)])
    star = house.open()
    joined = star["fact_prices"].select("ticker", "date", "close").join(star["fact_rolling"].select("ticker", "date", "sma_20").hint("merge"), ["ticker", "date"])
    assert "Exchange" not in plan_of(joined)
    with pytest.raises(ValueError, match="directory for each bucket"):
        Warehouse(spark, str(tmp_path / "other")).refresh(bars(spark, *history("K1", 3, 1.0)), "x", star["dim_etf"])


def test_refreshed_zones_reopen(spark, tmp_path):
    house, raw, attrs = built(spark, tmp_path, [b for k in KEYS for b in history(k, 30, 100.0)])
    again = Warehouse(spark.newSession(), house.root, SPEC, layout="hashed")
    for zone in ZONES:
        again.spark.sql(f"drop table {again.table(zone)}")
    again.open()
    assert again.refresh(bars(spark, *history("K7", 50, 60.0)), raw, attrs)
    check(again, raw, attrs)


def test_views_over_summaries_equal_those_over_facts(spark, tmp_path, plan_of):
    given = [b for i, k in enumerate(KEYS) for b in history(k, 80, 100.0 + i)]
    house, _, _ = built(spark, tmp_path, given)
    star, made = house.open(), house.summaries()
    dim, prices, rolling, anomalies = (star[t] for t in TABLES)
    months = made["summary_months"]
    pairs = [
        (summaries.category_performance(made["summary_days"], SPEC), views.category_performance(prices, dim, SPEC)),
        (summaries.category_volatility(months, dim, SPEC), views.category_volatility(rolling, dim, SPEC)),
        (summaries.risk_return(months, dim, SPEC), views.risk_return(prices, rolling, dim, SPEC)),
        (summaries.risk_return(months, dim, SPEC, total="last"), views.risk_return(prices, rolling, dim, SPEC, total="last")),
        (summaries.volatility_heatmap(months, dim, SPEC), views.volatility_heatmap(prices, rolling, dim, SPEC)),
        (summaries.anomalies_by_category(made["summary_anomalies"], dim, SPEC), reports.anomalies_by_category(anomalies, dim, SPEC)),
        (summaries.return_histogram(made["summary_histogram"], dim, SPEC), reports.instrument_histogram(prices, dim, spec=SPEC)),
    ]
    for from_partials, from_facts in pairs:
        assert rows(from_partials) == rows(from_facts)
        assert sorted(from_partials.dtypes) == sorted(from_facts.dtypes)
        assert not any("/fact_" in f for f in from_partials.inputFiles())


def test_a_stored_schema_saves_the_footers(spark, tmp_path):
    path = tmp_path / "raw"
    sinks.replace_keys(bars(spark, *[(k, 0, 1.0, 1, "1") for k in KEYS]), str(path), SPEC, 8)
    for f in path.rglob("*.parquet"):
        f.write_bytes(b"unreadable")
    planned = panel.read_panel(spark, str(path), SPEC)
    assert {"ticker", "date", "close", "key_bucket"} <= set(planned.columns)
    assert panel.read_zone(spark, str(path)).columns == planned.columns


def test_columns_widen_and_come_in(spark, tmp_path):
    path = str(tmp_path / "raw")
    old = bars(spark, *[(k, 0, 1.0, 5, "1") for k in "ABCDE"]).withColumns({"volume": F.col("volume").cast("int"), "close": F.col("close").cast("float")})
    sinks.replace_keys(old, path, SPEC, 2)
    new = bars(spark, ("A", 1, 2.5, 2**40, "2")).withColumn("note", F.lit("n"))
    sinks.replace_keys(new, path, SPEC, 2)
    sinks.replace_keys(old.filter("ticker = 'B'"), path, SPEC, 2)  # narrower again: read as the wider type
    got = panel.read_panel(spark, path, SPEC)
    assert dict(got.dtypes)["volume"] == "bigint" and dict(got.dtypes)["close"] == "double"
    assert sorted(map(tuple, got.select("ticker", "close", "volume", "note").collect())) == [("A", 2.5, 2**40, "n")] + [(k, 1.0, 5, None) for k in "BCDE"]
    with pytest.raises(ValueError, match="other types: close"):
        sinks.replace_keys(new.withColumn("close", F.lit("text")), path, SPEC, 2)


def test_schemas_grow():
    int_, long_, text = T.IntegerType(), T.LongType(), T.StringType()
    a = T.StructType([T.StructField("x", int_), T.StructField("y", text)])
    b = T.StructType([T.StructField("x", long_), T.StructField("z", text)])
    assert [(f.name, f.dataType) for f in schema.widened(a, b).fields] == [("x", long_), ("y", text), ("z", text)]
    assert schema.wider(long_, int_) == long_ and schema.wider(int_, text) is None and schema.wider(T.FloatType(), T.DoubleType()) == T.DoubleType()
