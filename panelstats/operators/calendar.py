"""Days a series has no row for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import in_order


def densify(df: DataFrame, key: str, ts: str, calendar: DataFrame | None = None) -> DataFrame:
    """Add a row with NULL measures for every calendar day inside a gap of a series.

    ``calendar`` holds the days (column ``ts``) that count, by default all days seen in the panel.
    Missing days are generated from each gap, between a row and its successor, and then checked
    against the calendar; keys and days are never multiplied with each other.  The calendar is
    broadcast: it has at most one row per date.
    """
    if not isinstance(df.schema[ts].dataType, T.DateType):
        raise ValueError("only a panel of days has a calendar")
    days = (df if calendar is None else calendar).select(ts).distinct()
    successor = F.lead(ts).over(in_order(key, ts))
    gaps = df.select(key, F.col(ts).alias("_from"), successor.alias("_to")).filter(
        F.date_diff("_to", "_from") > 1
    )
    inside = F.sequence(F.date_add("_from", 1), F.date_sub("_to", 1))
    missing = gaps.select(key, F.explode(inside).alias(ts)).join(F.broadcast(days), ts, "left_semi")
    return df.unionByName(missing, allowMissingColumns=True)
