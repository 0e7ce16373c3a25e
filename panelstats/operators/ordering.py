"""Total orders and top-k, with NULL placement and ties stated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_view(df: DataFrame, *by: str | Column) -> DataFrame:
    """Global sort.  A name sorts ascending, ``-name`` descending, both with NULLs last; a Column as is.

    The sort is a range exchange over all its columns, so a frequent leading value is split by the
    columns behind it.
    """
    return df.orderBy(*[_order(b) for b in by])


def top_k(df: DataFrame, by: str, k: int = 5, tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` greatest rows by ``by``; ``tie`` makes the choice among equals deterministic.

    Planned as take-ordered: each task keeps ``k`` rows, no global sort takes place.
    """
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]).limit(k)


def _order(by: str | Column) -> Column:
    if isinstance(by, Column):
        return by
    return F.col(by[1:]).desc_nulls_last() if by.startswith("-") else F.col(by).asc_nulls_last()
