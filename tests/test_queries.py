"""Every registered query against its SQL twin."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from panelcheck.compare import difference
from panelcheck.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(name, zones, con):
    build, oracle = QUERIES[name]
    assert oracle is not None
    assert difference(build(zones), con, oracle) is None


def test_contract_lists_every_query():
    more = set(contract.queries()) - set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and all(n.startswith("op") or n == "pipeline" for n in more)
    assert set(contract.oracle_sql()) - more <= set(QUERIES)


def test_entry_counts_every_anomaly_once(spark):
    rows = contract.entry(spark).collect()
    assert rows
    assert all(r.spike_up + r.spike_down == r.anomalie_totali >= r.extreme for r in rows)
