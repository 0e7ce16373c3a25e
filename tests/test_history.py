"""Dimension versions and lookups as of a day."""

from __future__ import annotations

import datetime as dt

import pytest

from panelstats.operators.history import FROM, TO, current, merge_dim, with_dim_as_of

D = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(30)]


def dim(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, category string, provider string")


def versions(df):
    return sorted(((r.ticker, r.category, r.provider, r[FROM], r[TO]) for r in df.collect()), key=str)


def test_versions_open_and_close(spark):
    h = merge_dim(None, dim(spark, ("A", "x", "p"), ("B", "y", None)), D[0], "ticker")
    assert versions(h) == [("A", "x", "p", D[0], None), ("B", "y", None, D[0], None)]
    h = merge_dim(h, dim(spark, ("A", "x", "p"), ("B", "y", None)), D[3], "ticker")  # nothing changed
    assert versions(h) == [("A", "x", "p", D[0], None), ("B", "y", None, D[0], None)]
    h = merge_dim(h, dim(spark, ("A", "z", "p"), ("C", "n", "q")), D[5], "ticker")
    want = [("A", "x", "p", D[0], D[5]), ("A", "z", "p", D[5], None), ("B", "y", None, D[0], None), ("C", "n", "q", D[5], None)]
    assert versions(h) == want
    assert versions(merge_dim(h, dim(spark, ("A", "z", "p"), ("C", "n", "q")), D[5], "ticker")) == want  # repeated
    again = merge_dim(h, dim(spark, ("A", "w", "p")), D[5], "ticker")  # corrected on the same day
    assert ("A", "w", "p", D[5], None) in versions(again) and not any(v[1] == "z" for v in versions(again))
    gone = merge_dim(h, dim(spark, ("B", "y", "now"), ("B", "y", "zz")), D[9], "ticker", closed=True)
    assert versions(gone) == [
        ("A", "x", "p", D[0], D[5]), ("A", "z", "p", D[5], D[9]), ("B", "y", "now", D[9], None), ("B", "y", None, D[0], D[9]), ("C", "n", "q", D[5], D[9])
    ]
    assert sorted(r.ticker for r in current(gone).collect()) == ["B"]
    with pytest.raises(Exception, match="a later day is stored"):
        merge_dim(gone, dim(spark, ("A", "x", "p")), D[2], "ticker").collect()


def test_lookup_as_of_a_day(spark, plan_of):
    h = merge_dim(None, dim(spark, ("A", "x", "p")), D[2], "ticker")
    h = merge_dim(h, dim(spark, ("A", "y", "p"), ("B", "b", "q")), D[5], "ticker")
    h = merge_dim(h, dim(spark, ("A", "y", "p")), D[8], "ticker", closed=True)
    h = spark.createDataFrame(h.collect(), h.schema)
    rows = [(k, D[d], float(d), "own") for k in ("A", "B", "C", None) for d in range(11)] + [("A", D[6], 6.5, "own")]
    fact = spark.createDataFrame(rows, "ticker string, date date, close double, _day string")
    got = with_dim_as_of(fact, h, "ticker", "date", ["category"])
    assert got.columns == ["ticker", "date", "close", "_day", "category"]
    found = sorted((r.ticker, r.close, r.category) for r in got.collect())
    want = [("A", float(d), "x" if d < 5 else "y") for d in range(2, 11)] + [("A", 6.5, "y")] + [("B", float(d), "b") for d in range(5, 8)]
    assert found == sorted(want)
    plan = plan_of(got)
    assert "Join" not in plan
