"""Interleaved placement: slices read few row groups."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from panelstats.sources.placement import KEY_HASH, interleaved, key_hashes, slice_of, write_interleaved
from panelstats.spec import PanelSpec

from test_refresh import rows

SPEC = PanelSpec()


def row_groups(path):
    """(first day, last day, least hash, greatest hash) of every row group."""
    found = []
    for f in sorted(Path(path).glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            day, number = (meta.row_group(g).column(names.index(c)).statistics for c in ("date", KEY_HASH))
            found.append((day.min, day.max, number.min, number.max))
    return found


def test_a_month_and_a_series_read_few_row_groups(spark, tmp_path):
    days = [dt.date(1995, 1, 1) + dt.timedelta(d) for d in range(0, 2400, 3)]
    fact = spark.range(150).select(F.format_string("K%04d", "id").alias("ticker"), F.explode(F.array(*map(F.lit, days))).alias("date"))
    fact = fact.withColumn("close", F.rand(1))
    path = str(tmp_path / "fact")
    back = write_interleaved(fact, path, SPEC, files=256)
    assert rows(back.drop(KEY_HASH)) == rows(fact)
    groups = row_groups(path)
    first, last = dt.date(1997, 6, 1), dt.date(1997, 7, 1)
    month = sum(a < last and b >= first for a, b, _, _ in groups)
    (number,) = key_hashes(spark, ["K0077"])
    series = sum(a <= number <= b for _, _, a, b in groups)
    assert len(groups) >= 200 and 0 < month <= len(groups) / 10 and 0 < series <= len(groups) / 3
    got = slice_of(back, SPEC, first, last)
    assert rows(got) == rows(fact.filter((F.col("date") >= first) & (F.col("date") < last)))
    assert rows(slice_of(back, SPEC, keys=["K0077", "none"])) == rows(fact.filter("ticker = 'K0077'"))
    assert slice_of(back, SPEC, keys=[]).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,1997-06-01)" in plan and "LessThan(date,1997-07-01)" in plan


def test_bits_take_turns(spark):
    got = spark.range(1).select(interleaved(F.lit(0b101), F.lit(0b01), 3, 2), interleaved(F.lit(1), F.lit(0b111), 1, 3), interleaved(F.lit(0b100), F.lit(0b11), 3, 2, 2)).first()
    assert tuple(got) == (0b10011, 0b1111, 0b10011)


def test_odd_facts(spark, tmp_path):
    fact = spark.createDataFrame([("A", None, 1.0), (None, dt.date(2020, 1, 1), 2.0)], "ticker string, date date, close double")
    assert rows(write_interleaved(fact, str(tmp_path / "a"), SPEC, 3).drop(KEY_HASH)) == rows(fact)
    assert write_interleaved(fact.limit(0), str(tmp_path / "b"), SPEC, 3).count() == 0
