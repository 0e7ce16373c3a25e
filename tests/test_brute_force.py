"""Random panels through the whole pipeline against plain Python, series by series."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import pytest

from panelstats.plans import views
from panelstats.plans.reports import anomalies_by_category, return_histogram
from panelstats.plans.staging import build_staging
from panelstats.plans.star import anomaly_fact, price_fact, rolling_fact
from panelstats.spec import PanelSpec

from test_micro import BAR

SPEC = PanelSpec(sma_frames=(4, 70), vol_frame=6, anomaly_z=1.5, high_z=2.0, extreme_z=3.0)
PRICES = ("open", "high", "low", "close")


def random_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        key, length = f"K{k:02d}", rng.choice([1, 2, 3, 10, 40, 150])
        flat = rng.random() < 0.1
        for i in range(length):
            if rng.random() < 0.1:
                continue
            day = dt.date(2020, 1, 1) + dt.timedelta(i)
            for version in range(rng.choice([1, 1, 1, 2, 3])):
                bar = [
                    None if rng.random() < 0.15 else (7.0 if flat else rng.randrange(0, 2000) / 4)
                    for _ in PRICES
                ]
                volume = None if rng.random() < 0.2 else (5 if flat else rng.randrange(0, 90))
                rows.append((key, day, *bar, volume, key, f"v{version}"))
    rng.shuffle(rows)
    return rows


def divide(a, b):
    return None if a is None or b is None or b == 0 else a / b


def standardise(values):
    known = [v for v in values if v is not None]
    if len(known) < 2:
        return [None] * len(values)
    mean, dev = sum(known) / len(known), statistics.stdev(known)
    return [None if v is None else divide(v - mean, dev if dev > 1e-12 else 0) for v in values]


def expected(rows) -> dict[tuple, dict]:
    newest: dict[tuple, tuple] = {}
    for row in rows:
        at = row[0], row[1]
        if at not in newest or row[8] > newest[at][8]:
            newest[at] = row
    out = {}
    for key in sorted({k for k, _ in newest}):
        last = dict.fromkeys((*PRICES, "volume"))
        series = []
        for at in sorted(a for a in newest if a[0] == key):
            row = newest[at]
            for name, value in zip((*PRICES, "volume"), row[2:7]):
                last[name] = value if value is not None else last[name]
            if last["close"] is not None:
                series.append(dict(last, ticker=key, date=at[1], ingestion_date=row[8]))
        closes = [r["close"] for r in series]
        for i, r in enumerate(series):
            r["daily_return"] = divide(closes[i] - closes[i - 1], closes[i - 1]) if i else None
            level = divide(closes[i], closes[0])
            r["close_norm"] = None if level is None else level * 100
            for n in SPEC.sma_frames:
                frame = closes[max(0, i - n + 1) : i + 1]
                r[f"sma_{n}"] = sum(frame) / len(frame)
            r["drawdown"] = divide(closes[i] - max(closes[: i + 1]), max(closes[: i + 1]))
        returns = [r["daily_return"] for r in series]
        for i, (r, zr, zv) in enumerate(
            zip(series, standardise(returns), standardise([r["volume"] for r in series]))
        ):
            r["return_zscore"], r["volume_zscore"] = zr, zv
            seen = [x for x in returns[max(0, i - 5) : i + 1] if x is not None]
            r[SPEC.volatility] = statistics.stdev(seen) * math.sqrt(252) if len(seen) > 1 else None
            out[key, r["date"]] = r
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pipeline(spark, seed):
    rows = random_rows(seed)
    # Versions of a bar are unique per label, so the survivor is known.
    want = expected(rows)
    staging = build_staging(spark.createDataFrame(rows, BAR), SPEC).cache()
    indicators = ["daily_return", "close_norm", "return_zscore", "volume_zscore"]
    for table, cols in (
        (staging, [*PRICES, "volume", "ingestion_date", *indicators]),
        (rolling_fact(staging, SPEC), ["sma_4", "sma_70", SPEC.volatility, "drawdown"]),
    ):
        got = {(r.ticker, r.date): r for r in table.collect()}
        assert set(got) == set(want)
        for at, row in got.items():
            for c in cols:
                value = want[at][c]
                if isinstance(value, float):
                    value = pytest.approx(value, rel=1e-9, abs=1e-9)
                assert row[c] == value, (at, c)

    unusual = {at for at, r in want.items() if r["return_zscore"] is not None and abs(r["return_zscore"]) > 1.5}
    anomalies = anomaly_fact(staging, SPEC)
    assert {(r.ticker, r.date) for r in anomalies.collect()} == unusual
    dim = spark.createDataFrame(
        [(k, k, "p", "even" if int(k[1:]) % 2 == 0 else "odd") for k in {k for k, _ in want}],
        "ticker string, etf_name string, provider string, category string",
    )
    report = {r.category: r for r in anomalies_by_category(anomalies, dim, SPEC).collect()}
    for parity, name in enumerate(("even", "odd")):
        of_category = [want[a] for a in unusual if int(a[0][1:]) % 2 == parity]
        assert report[name].anomalie_totali == len(of_category)
        assert report[name].spike_up == sum(r["daily_return"] > 0 for r in of_category)
        assert report[name].extreme == sum(abs(r["return_zscore"]) > 3 for r in of_category)
    view = views.normalized_prices(price_fact(staging, SPEC), dim, SPEC)
    counted = sum(r.frequency for r in return_histogram(view, spec=SPEC).collect())
    assert counted == sum(r["daily_return"] is not None for r in want.values())
    staging.unpersist()
