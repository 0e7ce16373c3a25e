"""Views stored in the catalog."""

from __future__ import annotations

from dataclasses import replace

import pytest

from panelstats.plans.lasting import create_views
from panelstats.plans.warehouse import Warehouse, publish, star_views

from test_refresh import rows


def test_another_session_reads_the_views(spark, zones):
    star, house = zones.star, zones.warehouse
    spark.sql("create database if not exists lasting")
    names = create_views(house, "lasting")
    other = spark.newSession()
    want = star_views(star, zones.spec)
    assert [n.split(".")[1] for n in names] == list(want)
    for name, df in zip(names, want.values(), strict=True):
        got = other.sql(f"select * from {name}")
        assert sorted(got.dtypes) == sorted(df.dtypes)
        assert rows(got) == rows(df), name


def test_views_follow_their_tables_and_the_spec(spark, zones, tmp_path):
    zones.star
    names = create_views(zones.warehouse, None)
    publish(zones.star, zones.spec)  # views of this session hide the stored ones here only
    assert spark.newSession().sql(f"select count(*) from {names[0]}").first()[0] == zones.prices.count()
    assert create_views(zones.warehouse, None) == names
    with pytest.raises(ValueError, match="registered tables"):
        create_views(Warehouse(spark, str(tmp_path / "x"), replace(zones.spec), layout="key"))
    for name in names:
        spark.newSession().sql(f"drop view {name}")
