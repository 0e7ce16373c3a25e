"""Series that grow by deliveries against the same rows in one run."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from panelstats.operators import segments
from panelstats.operators.appended import AppendedPanel
from panelstats.spec import INSTANT, PanelSpec

from test_micro import bars

SPEC = PanelSpec(grain=INSTANT)


def ticks(spark, *rows):
    return bars(spark, *rows).withColumn("date", F.col("date").cast("timestamp_ntz"))


def rows(df, digits=9):
    names = sorted(df.columns)
    return sorted((tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect()), key=str)


def walk(seed, keys=("A", "B", "C", "D"), days=560):
    """A long series, shorter ones, gaps, leading gaps, corrections, and a series that begins late."""
    rng, out = random.Random(seed), []
    for i, k in enumerate(keys):
        level = 100.0
        for d in range(0 if i < 3 else 300, days, 1 if i == 0 else 3 * i):
            level += rng.choice((-1.5, -0.5, 0.0, 0.5, 2.0))
            price = None if rng.random() < 0.1 or (i == 1 and d < 200) else level
            out.append((k, d, price, None if rng.random() < 0.1 else rng.randrange(50), "1"))
            if rng.random() < 0.05:
                out.append((k, d, level + 1, 7, "2"))
    return out


def appended(spark, path, given, cuts, partitions=6):
    panel, low = AppendedPanel(spark, str(path), SPEC, partitions), -1
    for high in (*cuts, 10**6):
        panel.append(ticks(spark, *[g for g in given if low < g[1] <= high]) if any(low < g[1] <= high for g in given) else ticks(spark, given[0]).limit(0))
        low = high
    return panel


@pytest.mark.parametrize("cuts", [(0, 1, 260), (5000,)])
def test_deliveries_equal_one_run(spark, tmp_path, cuts):
    given = walk(1)
    panel = appended(spark, tmp_path / "appended", given, cuts)
    whole = segments.segmented_staging(ticks(spark, *given), SPEC, str(tmp_path / "whole"), 6)
    assert panel.deliveries() == len(cuts) + 1 and panel.late().count() == 0
    assert rows(panel.staging()) == rows(whole.unsegmented())
    assert rows(panel.rolling()) == rows(segments.segmented_rolling(whole))
    stats = whole.rows.groupBy("ticker").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("trading_days"), F.round(F.avg("volume"), 0).alias("avg_daily_volume")
    )
    assert rows(panel.series()) == rows(stats)


def test_stored_rows_are_not_read(spark, tmp_path):
    given = walk(2, days=300)
    panel = appended(spark, tmp_path, [g for g in given if g[1] <= 200], ())
    for zone in ("rows", "rolling", "work", "late"):
        for f in (tmp_path / zone).rglob("*.parquet"):
            f.write_bytes(b"unreadable")
    assert panel.append(ticks(spark, *[g for g in given if g[1] > 200])) == 1
    assert spark.read.parquet(str(tmp_path / "rows" / "delivery=1")).count() > 0


def test_late_bars_change_nothing(spark, tmp_path):
    given = walk(3, days=300)
    panel = appended(spark, tmp_path, given, (100,))
    before = rows(panel.staging()), rows(panel.rolling())
    panel.append(ticks(spark, ("A", 50, 1.0, 1, "9"), ("A", 299, 1.0, 1, "9"), ("B", 10, 5.0, 5, "9")))
    assert (rows(panel.staging()), rows(panel.rolling())) == before and panel.late().count() == 3
    panel.append(ticks(spark, ("A", 400, 123.0, 1, "9"), ("A", 200, 1.0, 1, "9")))
    assert panel.late().count() == 4 and panel.rolling().count() == len(before[1]) + 1


def test_a_failed_delivery_is_taken_again(spark, tmp_path, monkeypatch):
    given = walk(4, days=200)
    panel = appended(spark, tmp_path / "a", [g for g in given if g[1] <= 100], ())
    rest = ticks(spark, *[g for g in given if g[1] > 100])

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(AppendedPanel, "_next_state", fail)
        with pytest.raises(RuntimeError, match="lost"):
            panel.append(rest)
    assert panel.deliveries() == 1
    assert panel.append(rest) == 1
    whole = segments.segmented_staging(ticks(spark, *given), SPEC, str(tmp_path / "whole"), 6)
    assert rows(panel.staging()) == rows(whole.unsegmented())


def test_first_delivery_without_a_price(spark, tmp_path):
    """What unfilled bars tell of the other measures fills later bars."""
    given = [("A", 0, None, 5, "1"), ("A", 1, None, None, "1"), ("A", 2, 10.0, None, "1"), ("A", 3, 11.0, None, "1")]
    panel = appended(spark, tmp_path, given, (1,))
    assert [(r.close, r.volume, r.close_norm) for r in panel.staging().orderBy("date").collect()] == [(10.0, 5, 100.0), (11.0, 5, pytest.approx(110.0))]
    assert panel.staging().select("daily_return").orderBy("date").collect()[0][0] is None
