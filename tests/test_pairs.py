"""All strongly correlated pairs: candidates and exact check."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from panelstats.plans import distribution
from panelstats.spec import PanelSpec

SPEC = PanelSpec()
DAY = dt.date(2020, 1, 1)


def frame(spark, series):
    """key -> {day: return} as rows."""
    rows = [(k, DAY + dt.timedelta(int(d)), None if v is None else float(v)) for k, s in series.items() for d, v in s.items()]
    return spark.createDataFrame(rows, "ticker string, date date, daily_return double")


def plain(series, threshold, overlap):
    keys, out = sorted(series), []
    series = {k: {d: v for d, v in s.items() if v is not None} for k, s in series.items()}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            common = sorted(series[a].keys() & series[b].keys())
            if len(common) >= 2 and len(common) >= overlap * max(len(series[a]), len(series[b])):
                x, y = (np.array([series[k][d] for d in common]) for k in (a, b))
                if x.std() and y.std():
                    c = np.corrcoef(x, y)[0, 1]
                    if c >= threshold:
                        out.append((a, b, len(common), round(c, 9)))
    return out


def made(seed, groups, each, days=260, noise=0.35):
    rng = np.random.default_rng(seed)
    series = {}
    for g in range(groups):
        base = rng.normal(0, 0.01, days)
        for i in range(each):
            values = base + rng.normal(0, 0.01 * noise, days)
            gone = set(rng.choice(days, rng.integers(0, 12), replace=False).tolist())
            series[f"S{g:03d}_{i}"] = {d: v for d, v in enumerate(values) if d not in gone}
    return series


@pytest.mark.parametrize(("threshold", "overlap"), [(0.8, 0.9), (0.6, 0.8)])
def test_pairs_against_all_pairs(spark, threshold, overlap):
    series = made(1, 30, 4)
    got = distribution.correlated_pairs(frame(spark, series), threshold, SPEC, overlap=overlap).collect()
    want = plain(series, threshold, overlap)
    assert want and sorted((r.key_a, r.key_b, r.days, round(r.correlation, 9)) for r in got) == want


def test_measured_recall_at_the_threshold(spark):
    """Pairs just at the design point are found as often as promised, unrelated ones seldom compared."""
    rng, days, rho = np.random.default_rng(2), 500, 0.72
    series = {}
    for i in range(300):
        x, e = rng.normal(0, 1, (2, days))
        series[f"{i:03d}a"] = dict(enumerate(x))
        series[f"{i:03d}b"] = dict(enumerate(rho * x + np.sqrt(1 - rho * rho) * e))
    bits = 10
    bands = distribution.bands_needed(0.8, 0.9, bits, 0.99)
    pairs = distribution.candidate_pairs(distribution.return_sketches(frame(spark, series), bands, bits)).collect()
    assert len({(r.key_a, r.key_b) for r in pairs}) == len(pairs)
    found = sum(r.key_a[:3] == r.key_b[:3] for r in pairs)
    assert found >= 0.97 * 300
    assert len(pairs) - found < 0.2 * 600 * 599 / 2
    apart = distribution.most_signs_apart(0.8, 0.9, bands * bits)
    left = distribution.candidate_pairs(distribution.return_sketches(frame(spark, series), bands, bits), apart=apart).collect()
    assert sum(r.key_a[:3] == r.key_b[:3] for r in left) == found and len(left) - found < 0.01 * len(pairs)


def test_odd_series(spark):
    flat = {d: 0.01 for d in range(50)}
    move = {d: (-1) ** d * 0.01 * (1 + d % 7) for d in range(50)}
    series = {"flat": flat, "flat2": flat, "one": {3: 0.5}, "none": {1: None, 2: None}, "move": move, "same": dict(move), "late": {d + 40: v for d, v in move.items()}}
    got = distribution.correlated_pairs(frame(spark, series), 0.9, SPEC).collect()
    assert [(r.key_a, r.key_b, r.days) for r in got] == [("move", "same", 50)]
    assert distribution.correlated_pairs(frame(spark, series).limit(0), 0.9, SPEC).collect() == []
    with pytest.raises(ValueError, match="positive shares"):
        distribution.correlated_pairs(frame(spark, series), 1.5, SPEC)


def test_no_cross_join(spark, plan_of):
    plan = plan_of(distribution.correlated_pairs(frame(spark, made(3, 5, 2, 60)), 0.9, SPEC))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    sketches = distribution.return_sketches(frame(spark, made(3, 5, 2, 60)), 20, 8)
    plan = plan_of(distribution.candidate_pairs(sketches))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_blocks_of_a_large_group_lose_no_pair(spark, monkeypatch):
    """Buckets cut into blocks, and pairs checked block by block, give all pairs of one large group."""
    for name, size in (("MET", 8), ("BLOCK", 5), ("GROUP", 40)):
        monkeypatch.setattr(distribution, name, size)
    series = made(4, 2, 24, 120, 0.2)
    got = distribution.correlated_pairs(frame(spark, series), 0.8, SPEC).collect()
    want = plain(series, 0.8, 0.9)
    assert len(want) > 500 and sorted((r.key_a, r.key_b, r.days, round(r.correlation, 9)) for r in got) == want


def test_pairs_of_a_block_as_one_by_one():
    """Repeated days, few common days, and returns that are constant over the common days."""
    rng = np.random.default_rng(5)
    days = np.arange(60, dtype="<i4")
    twice = (np.r_[days, 3, 3], rng.normal(1, 0.01, 62))
    flat = (days, np.where(days < 50, 0.3, rng.normal(0, 1, 60)))
    series = [(days, rng.normal(1, 0.01, 60)), twice, flat, (days[:50], rng.normal(0, 1, 50)), (days[49:51], np.array([1.0, 2.0])), (days[:1], np.ones(1))]
    a, b = (x.ravel() for x in np.indices((6, 6)))
    n, found = distribution._correlations(series, series, a, b)
    for i, j, k, c in zip(a, b, n, found, strict=True):
        x, y = zip(*[(v, w) for d, v in zip(*series[i], strict=True) for e, w in zip(*series[j], strict=True) if d == e], strict=True) if k else ((), ())
        assert k == len(x)
        if k > 1 and len(set(x)) > 1 and len(set(y)) > 1:
            assert c == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
        else:
            assert np.isnan(c)


def test_bands_stay_few_for_many_series(spark, monkeypatch):
    """A panel of many series gets a few hundred signs a series, not thousands."""
    asked = []
    monkeypatch.setattr(distribution, "return_sketches", lambda r, bands, bits, *rest: asked.append((bands, bits)) or r.limit(0))
    monkeypatch.setattr(distribution, "candidate_pairs", lambda *_: (_ for _ in ()).throw(StopIteration))
    many = spark.range(180_000).selectExpr("cast(id as string) ticker", "date'2020-01-01' date", "0.1D daily_return")
    with pytest.raises(StopIteration):
        distribution.correlated_pairs(many, 0.8, SPEC)
    bands, bits = asked[0]
    assert bands * bits <= 1000 and 180_000 >> bits <= 2048
