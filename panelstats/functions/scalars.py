"""Column expressions: labels, flags, ratios, rounding.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels written to the warehouse.
POSITIVE, NEGATIVE, FLAT = "positive", "negative", "flat"
SPIKE_UP, SPIKE_DOWN = "spike_up", "spike_down"
EXTREME, HIGH, MODERATE = "extreme", "high", "moderate"

# Relative error of a sum of a few hundred doubles, with a wide margin.
ROUNDING_ERROR = 1e-12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Division that yields NULL, not an ANSI error, for a zero denominator."""
    return F.try_divide(col(numerator), col(denominator))


def change(now: Column | str, before: Column | str) -> Column:
    """Relative change from ``before`` to ``now``."""
    return ratio(col(now) - col(before), before)


def pct(c: Column | str, digits: int) -> Column:
    return F.round(col(c) * 100, digits)


def cumulative_return(close_norm: Column | str, base: float = 100.0) -> Column:
    return (col(close_norm) - F.lit(base)) / F.lit(base)


def day_direction(ret: Column | str) -> Column:
    """A NULL return counts as flat."""
    ret = col(ret)
    return F.when(ret > 0, POSITIVE).when(ret < 0, NEGATIVE).otherwise(FLAT)


def anomaly_type(ret: Column | str) -> Column:
    return F.when(col(ret) > 0, SPIKE_UP).otherwise(SPIKE_DOWN)


def anomaly_severity(z: Column | str, high: float = 3.0, extreme: float = 4.0) -> Column:
    size = F.abs(col(z))
    return F.when(size > extreme, EXTREME).when(size > high, HIGH).otherwise(MODERATE)


def trend_signal(
    close: Column | str, sma: Column | str, label: str = "sma252", tolerance: float = ROUNDING_ERROR
) -> Column:
    """Close above, below or at its average; a NULL on either side counts as at.

    The average carries the rounding error of its sum.  Differences no larger than ``tolerance`` times the
    average are none, so the signal does not depend on the order in which the prices were added up;
    0 compares exactly.
    """
    close, sma = col(close), col(sma)
    apart = F.abs(close - sma) > F.abs(sma) * tolerance
    return (
        F.when(apart & (close > sma), f"above_{label}")
        .when(apart & (close < sma), f"below_{label}")
        .otherwise(f"at_{label}")
    )


def volume_outlier_flag(z: Column | str, threshold: float = 3.0) -> Column:
    """Three-valued: NULL for a NULL z-score."""
    return F.abs(col(z)) > threshold


def high_volume_flag(z: Column | str, threshold: float = 2.0) -> Column:
    """Two-valued: false for a NULL z-score."""
    return F.coalesce(F.abs(col(z)) > threshold, F.lit(False))


def month_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def bucket(c: Column | str, width: float) -> Column:
    """Centre of the histogram bucket of the given width that holds the value."""
    return F.round(col(c) / width) * width


# Aggregate expressions


def mean_rounded(c: Column | str, digits: int) -> Column:
    return F.round(F.avg(col(c)), digits)


def rel_range(c: Column | str) -> Column:
    return change(F.max(col(c)), F.min(col(c)))


def first_by(c: Column | str, ts: Column | str) -> Column:
    """Value of the earliest row whose value is not NULL."""
    c, ts = col(c), col(ts)
    return F.min_by(c, F.when(c.isNotNull(), ts))


def last_by(c: Column | str, ts: Column | str) -> Column:
    c, ts = col(c), col(ts)
    return F.max_by(c, F.when(c.isNotNull(), ts))


def label_counts(wanted: dict[str, Column]) -> list[Column]:
    """One conditional count per ``name -> predicate``."""
    return [F.count_if(predicate).alias(name) for name, predicate in wanted.items()]
