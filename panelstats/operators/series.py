"""Per-series indicators over one ordered window: returns, rebasing, rolling statistics, drawdown.

Every function asks for the same partitioning and order, so a chain of them costs one exchange and
one sort.  They sort a whole series in one task, which is bounded for a deduplicated daily panel
(see ``PanelSpec``); for series of unbounded length use :mod:`panelstats.operators.segments`.
"""

from __future__ import annotations

from functools import reduce
from math import sqrt
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import change, ratio
from ..spec import in_order, sma_name, so_far, trailing

# Frames from this length on are assembled from shorter ones, so many at a time.
LONG_FRAME = 64
PIECES = (7, 6, 5, 4)


def simple_return(df: DataFrame, key: str | list[str], ts: str, price: str, out: str = "daily_return") -> DataFrame:
    """Relative change from the previous row of the series; NULL on its first row."""
    return df.withColumn(out, change(price, F.lag(price).over(in_order(key, ts))))


def rebase(
    df: DataFrame, key: str | list[str], ts: str, price: str, base: float = 100.0, out: str = "close_norm"
) -> DataFrame:
    """Price relative to the first non-NULL price of its series, which becomes ``base``."""
    start = F.first(price, ignorenulls=True).over(so_far(key, ts))
    return df.withColumn(out, ratio(price, start) * base)


def moving_avg(
    df: DataFrame, key: str | list[str], ts: str, price: str, rows: int, out: str | None = None
) -> DataFrame:
    """Mean of the trailing ``rows`` prices; the first rows of a series use what there is."""
    out = out or sma_name(rows)
    if rows < LONG_FRAME:
        return df.withColumn(out, F.avg(price).over(trailing(key, ts, rows)))
    totals = trailing_totals(df, key, ts, price, rows, "_frame")
    return totals.withColumn(out, ratio("_frame_sum", "_frame_n")).drop("_frame_sum", "_frame_n")


def trailing_totals(
    df: DataFrame, key: str | list[str], ts: str, value: str, rows: int, out: str
) -> DataFrame:
    """Add ``<out>_sum`` and ``<out>_n``, the sum and the count of the trailing ``rows`` values.

    A sliding frame is added up anew on every row, so its cost grows with its length.  A long frame
    is therefore put together from shorter ones looked up with ``lag``, and those in turn from
    shorter ones: 252 rows are 7 x 6 x 6.  It is the same sum over the same window and sort, with
    nothing subtracted, in 19 steps instead of 252.
    """
    if rows <= max(PIECES):
        w = trailing(key, ts, rows)
        return df.withColumns(
            {f"{out}_sum": F.sum(value).over(w), f"{out}_n": F.count(value).over(w)}
        )
    pieces = next((p for p in PIECES if rows % p == 0), max(PIECES))
    length, rest = divmod(rows, pieces)
    df = trailing_totals(df, key, ts, value, length, f"{out}_piece")
    if rest:
        df = trailing_totals(df, key, ts, value, rest, f"{out}_rest")
    w = in_order(key, ts)

    def total(of: str) -> Column:
        terms = [F.col(f"{out}_piece_{of}")]
        terms += [F.lag(f"{out}_piece_{of}", length * i).over(w) for i in range(1, pieces)]
        if rest:
            terms.append(F.lag(f"{out}_rest_{of}", length * pieces).over(w))
        return reduce(add, [F.coalesce(t, F.lit(0)) for t in terms])

    helpers = [f"{out}_{part}_{of}" for part in ("piece", "rest") for of in ("sum", "n")]
    return df.withColumns({f"{out}_{of}": total(of) for of in ("sum", "n")}).drop(*helpers)


def rolling_vol(
    df: DataFrame, key: str | list[str], ts: str, ret: str, rows: int = 30, periods: int = 252, out: str | None = None
) -> DataFrame:
    """Sample deviation of the trailing returns, scaled to a year of ``periods`` rows."""
    spread = F.stddev_samp(ret).over(trailing(key, ts, rows))
    return df.withColumn(out or f"volatility_{rows}_annualized", spread * F.lit(sqrt(periods)))


def running_max(df: DataFrame, key: str | list[str], ts: str, price: str, out: str = "running_max") -> DataFrame:
    return df.withColumn(out, F.max(price).over(so_far(key, ts)))


def drawdown(df: DataFrame, key: str | list[str], ts: str, price: str, out: str = "drawdown") -> DataFrame:
    """Distance below the highest price so far, as a fraction of it: zero or negative."""
    return df.withColumn(out, change(price, F.max(price).over(so_far(key, ts))))
