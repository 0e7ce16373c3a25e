"""Strassen products, heaps and hard negatives against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcheck.compare import difference
from panelstats.llm import negatives
from panelstats.llm.heaps import Heaps, merged
from panelstats.llm.queries import ORACLES, QUERIES
from panelstats.llm.strassen import multiply
from tests.conftest import SF_DIR

SCHEMA = "vec_id long, embedding array<float>, label int, id string, numbers int, part int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 65, 40), (70, 64, 130), (0, 64, 5), (40, 0, 40), (100, 37, 99)])
def test_products_are_exact(shape):
    random_of = np.random.default_rng(1).integers
    m, k, n = shape
    a, b = random_of(-(2**40), 2**40, (m, k)), random_of(-(2**15), 2**15, (k, n))
    assert (multiply(a, b, leaf=8) == a @ b).all()
    big = np.full((50, 50), 2**31), np.full((50, 50), -(2**26))  # sums between leave 64 bits, results don't
    assert (multiply(*big, leaf=4) == -50 * 2**57).all()


def test_heaps_against_sorting():
    rng = np.random.default_rng(2)
    for once in (True, False):
        heaps, given = Heaps(4, 3, once), []
        for _ in range(6):
            some = rng.integers(0, 4, 40), rng.integers(-5, 5, 40), rng.integers(0, 9, 40)
            given += list(zip(*(x.tolist() for x in some), strict=True))
            heaps.push(*some)
        for key in range(4):
            mine = [(s, i) for k, s, i in given if k == key]
            best = sorted(set(mine) if once else mine, key=lambda x: (-x[0], x[1]))[:3]
            assert [(s, i) for k, s, i in zip(heaps.key, heaps.score, heaps.id, strict=True) if k == key] == best


def test_lists_of_many_tasks_merge(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.col("id") % 700).alias("v"), F.col("id").alias("part"))
    got = merged(rows, ["k"], [F.col("v").desc()], 3, "part", 3000).collect()
    assert sorted((r.k, r.v) for r in got) == [(0, 694), (0, 696), (0, 698), (1, 695), (1, 697), (1, 699)]
    got = merged(rows, ["k"], [F.col("v").desc()], 3, "part", 3000, once=False).collect()
    assert sorted((r.k, r.v) for r in got) == [(0, 698)] * 3 + [(1, 699)] * 3


def plain(rows, every=10, k=5):
    """The contract, word by word."""
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])

    seen = sorted({(i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label, *_ in filter(usable, rows)})
    firsts = {}
    for r in seen:
        firsts.setdefault(r[0], r)
    out = []

    def score(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    for i, label, v in (r for r in firsts.values() if r[0] % every == 0):
        by_score = sorted({(-score(v, w), j, own == label) for j, own, w in seen})
        for p, j, _ in [x for x in by_score if x[2] and x[1] != i][:k]:
            fits = [x for x in by_score if not x[2] and -80 * p <= -100 * x[0] <= -100 * p][:k]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **how):
    got = negatives.mine_negatives(df, F.col("id") % 10 == 0, label=negatives.contract_label(), **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, i) for i, r in enumerate(rows)], SCHEMA)


def vectors(n, labels=3, width=7, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.1, 0.4) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("sizes", [(1024, 2048, 4096), (3, 16, 32)])
def test_against_plain_python(spark, written, sizes):
    rows = vectors(300)
    assert mined(written(frame(spark, rows), 5), sizes=sizes) == plain(rows)


def test_odd_rows(spark, written):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60) + [
        (100, None, 1), (110, [0.5, None] + [0.1] * 5, 1), (120, [nan] * 7, 1), (130, [inf] * 7, 1), (140, [0.2] * 7, None),
        (None, [0.9] * 7, 1), (150, [], 1), (160, [0.5, 0.5], 2), (161, [0.25] * 9, 2), (170, [-0.5] * 7, 7),
        (180, [0.0] * 7, 0), (30, [0.3] * 7, 1),
    ]
    rows += [(200, [0.5] * 7, 1)] * 40 + [(201, [0.5] * 7, 1)] * 40 + [(202, [0.5] * 7, 2)] * 40  # repeated rows and ties
    assert mined(written(frame(spark, rows)), sizes=(4, 16, 32)) == plain(rows)


def test_one_label_and_no_rows(spark, written):
    assert mined(written(frame(spark, [(i, [1.0, float(i)], 4) for i in range(7, 70, 7)]), 1)) == []
    assert mined(written(frame(spark, []), 1)) == []


def test_equal_vectors(spark, written):
    rows = [(i, [0.5, 0.25], i % 2) for i in range(120)]
    assert mined(written(frame(spark, rows)), sizes=(8, 16, 16)) == plain(rows)


def test_scores_beyond_64_bits_are_refused(spark, written):
    rows = [(i, [1e12, 1e12], i % 2) for i in range(20)]
    with pytest.raises(Exception, match="too large"):
        mined(written(frame(spark, rows)))


def test_query_equals_its_sql(spark, con):
    name = "op11_hard_negatives"
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, ORACLES[name]) is None
    assert df.count() > 0


def test_no_cross_join(spark, written, plan_of):
    plan = plan_of(negatives.mine_negatives(written(frame(spark, vectors(100))), F.col("id") % 10 == 0))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
