"""Cut series give the results of whole ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from panelstats.operators import segments
from panelstats.plans.staging import build_staging
from panelstats.plans.star import rolling_fact
from panelstats.spec import PanelSpec

from test_micro import BAR


def panel(spark, sizes: dict[str, int], seed: int = 7):
    """Series of the given lengths with gaps, missing starts and later versions."""
    rng = random.Random(seed)
    rows = []
    for key, n in sizes.items():
        price = 100.0
        for i in range(n):
            price = round(price + rng.uniform(-2, 2), 2)
            day = dt.date(2000, 1, 1) + dt.timedelta(i)
            shown = None if rng.random() < 0.15 or (i < 3 and key != "hot") else price
            volume = None if rng.random() < 0.2 else rng.randrange(1, 500)
            rows.append((key, day, shown, shown, shown, shown, volume, key, "1"))
            if rng.random() < 0.1:
                rows.append((key, day, price, price, price, price, volume, key, "2"))
    return spark.createDataFrame(rows, BAR)


def same(left, right, cols, digits=8):
    def rows(df):
        return sorted(
            (tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()),
            key=str,
        )

    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert [
            u if not isinstance(u, float) else pytest.approx(u, abs=1e-7) for u in x
        ] == list(y)


SMALL = PanelSpec(sma_frames=(3, 20), vol_frame=5)


@pytest.mark.parametrize(
    "sizes, partitions",
    [
        ({"hot": 400, "a": 20, "b": 1, "c": 3}, 12),
        ({"hot": 120, "z": 40}, 60),  # segments far shorter than the frames
        ({"a": 5, "b": 6}, 40),  # more partitions than rows
        ({"a": 30, "b": 30}, 1),  # nothing is cut
    ],
)
def test_equal_to_whole_series(spark, tmp_path, sizes, partitions):
    raw = panel(spark, sizes)
    whole = build_staging(raw, SMALL).cache()
    cut = segments.segmented_staging(raw, SMALL, str(tmp_path / "cut"), partitions)
    same(whole, cut.unsegmented(), whole.columns)
    rolling = rolling_fact(whole, SMALL)
    same(rolling, segments.segmented_rolling(cut), rolling.columns)
    whole.unpersist()


def test_long_frames_over_many_segments(spark, tmp_path):
    raw = panel(spark, {"hot": 700, "a": 90})
    whole = build_staging(raw).cache()
    cut = segments.split(whole, PanelSpec(), str(tmp_path / "cut"), 40)
    rolling = rolling_fact(whole)
    same(rolling, segments.segmented_rolling(cut), rolling.columns)
    whole.unpersist()


def test_missing_time_is_refused(spark, tmp_path):
    df = panel(spark, {"a": 3}).withColumn("date", F.lit(None).cast("date"))
    with pytest.raises(Exception, match="NULL date"):
        segments.split(df, PanelSpec(), str(tmp_path / "cut"))


def test_hot_series_is_spread_and_carried_rows_are_few(spark, tmp_path):
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("ticker"),
        F.date_add(F.lit("1900-01-01"), F.col("id").cast("int")).alias("date"),
        F.col("id").cast("double").alias("close"),
    )
    cut = segments.split(df, PanelSpec(), str(tmp_path / "cut"), 16)
    sizes = cut.rows.groupBy("ticker", "segment").count()
    assert sizes.agg(F.max("count")).first()[0] < 4_000  # of 10 000 rows of the hot series
    assert cut.spans.filter("ticker = 'hot'").count() >= 4
    assert cut.spans.count() <= 2 * 16
    assert cut.spans.groupBy("ticker").agg(F.sum("rows").alias("n")).filter("ticker = 'hot'").first().n == 10_000
    assert cut.unsegmented().exceptAll(df).isEmpty() and cut.rows.count() == 30_000


def test_bars_without_a_time_are_dropped_alike(spark, tmp_path):
    from panelstats.operators.quality import failed_casts
    from panelstats.operators.segments import segmented_staging
    from panelstats.plans.staging import build_staging
    from panelstats.spec import PanelSpec

    rows = [("A", "2024-01-02", "1.5", "7"), ("A", None, "9", "9"), ("A", "no day", "9", "9"), ("A", "2024-01-03", "2.5", "1000.0"), ("A", "2024-01-04", "x", "1e3")]
    raw = spark.createDataFrame(rows, "ticker string, date string, close string, volume string")
    raw = raw.selectExpr("*", "close open", "close high", "close low", "'n' etf_name", "'1' ingestion_date")
    spec = PanelSpec()
    plain = build_staging(raw, spec)
    cut = segmented_staging(raw, spec, str(tmp_path / "cut"), 4).unsegmented()
    show = lambda df: sorted((str(r.date), r.close, r.volume) for r in df.collect())
    assert show(plain) == show(cut) == [("2024-01-02", 1.5, 7), ("2024-01-03", 2.5, 1000), ("2024-01-04", 2.5, 1000)]
    failed = {r.column: r.failed for r in failed_casts(raw, spec).collect()}
    assert failed["date"] == 1 and failed["close"] == 1 and failed["volume"] == 0


def test_exact_trend_with_no_tolerance(spark):
    from panelstats.functions.scalars import trend_signal

    row = spark.sql("select 1.0D + 1e-14D as close, 1.0D as sma").select(
        trend_signal("close", "sma").alias("near"), trend_signal("close", "sma", tolerance=0.0).alias("exact")
    ).first()
    assert (row.near, row.exact) == ("at_sma252", "above_sma252")


def test_a_series_with_half_of_all_rows_is_stored_and_joined_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from panelstats.operators.joins import align_facts
    from panelstats.operators.segments import segmented_staging
    from panelstats.plans.segmented import write_segmented_star
    from panelstats.spec import PanelSpec

    spec = PanelSpec(grain="instant")
    raw = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("ticker"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("date"),
        *[(100 + F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10_007))).cast("double").alias(c) for c in spec.prices],
        F.col("id").alias("volume"), F.lit("n").alias("etf_name"), F.lit("1").alias("ingestion_date"),
    )
    cut = segmented_staging(raw, spec, str(tmp_path / "cut"), 16)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "16k")
    try:
        star = write_segmented_star(cut, raw.select("ticker").distinct(), str(tmp_path / "star"))
    finally:
        spark.conf.unset(size)
    for fact in ("fact_prices", "fact_rolling"):
        hot = star[fact].filter("ticker = 'hot'")
        assert hot.select(F.input_file_name()).distinct().count() > 2 and hot.count() == 100_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        both = align_facts(star["fact_prices"], star["fact_rolling"], spec.grid, ["close"], ["drawdown"])
        tasks = both.filter("ticker = 'hot'").select(F.spark_partition_id()).distinct().count()
        assert both.count() == 200_000 and tasks > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
