from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from panelcheck.compare import duck, local_session  # noqa: E402
from panelcheck.zones import zones as build_zones  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def zones(spark):
    return build_zones(spark, SF_DIR)


@pytest.fixture(scope="session")
def con():
    return duck(SF_DIR)


@pytest.fixture
def plan_of():
    """The final physical plan as text: run adaptively, then read."""

    def text(df) -> str:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=false" not in plan
        return plan.split("== Initial Plan ==")[0]

    return text
