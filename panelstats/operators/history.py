"""A dimension with history: versions of its members with the days they hold, and lookups as of a day.

A version holds from ``valid_from`` up to, not including, ``valid_to``; NULL there means until further notice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FROM, TO = "valid_from", "valid_to"


def merge_dim(history: DataFrame | None, arriving: DataFrame, day: dt.date | str, key: str, closed: bool = False) -> DataFrame:
    """History after attributes arrived on a day.

    A member whose attributes differ from its current version gets a new one from that day on; equal attributes
    change nothing, so a merge may be repeated.  A version that began on the same day is replaced.  New members begin
    on the day.  Members that don't arrive keep their version, or are ``closed`` on the day.  Days arrive in order;
    an earlier day than a stored version's is refused.  Of several arriving rows of a member the least one counts.
    """
    columns = [c for c in arriving.columns if c != key]
    day = F.lit(str(day)).cast("date")
    fresh = arriving.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("new"))
    if history is None:
        rows = fresh.select(key, F.col("new.*"), day.alias(FROM))
        return rows.withColumn(TO, F.lit(None).cast("date"))
    order = F.when(F.col(FROM) > day, F.raise_error(F.lit("a later day is stored already")).cast("date")).otherwise(F.col(FROM))
    history = history.withColumn(FROM, order)
    past = history.filter(F.col(TO).isNotNull())
    now = history.filter(F.col(TO).isNull()).select(key, F.struct(*columns).alias("old"), F.col(FROM).alias("since"))
    both = now.join(fresh, key, "full")
    stays = F.col("new").isNull() & F.lit(not closed) | F.col("old").eqNullSafe(F.col("new"))
    closes = F.col("old").isNotNull() & ~stays & (F.col("since") < day)
    opens = F.col("new").isNotNull() & ~stays
    version = "struct<" + ", ".join(f"`{n}`: {t}" for n, t in history.select(*columns, FROM, TO).dtypes) + ">"

    def made(of: str, since, until):
        return F.struct(*[F.col(f"{of}.`{c}`").alias(c) for c in columns], since.alias(FROM), until.alias(TO)).cast(version)

    none = F.lit(None).cast("date")
    kept = F.when(F.col("old").isNotNull() & stays, made("old", F.col("since"), none)).when(closes, made("old", F.col("since"), day))
    versions = F.filter(F.array(kept, F.when(opens, made("new", day, none))), lambda v: v.isNotNull())
    changed = both.select(key, F.explode(versions).alias("v")).select(key, "v.*")
    return past.unionByName(changed.select(*past.columns))


def current(history: DataFrame) -> DataFrame:
    """Today's versions, without their days."""
    return history.filter(F.col(TO).isNull()).drop(FROM, TO)


def with_dim_as_of(fact: DataFrame, history: DataFrame, key: str, ts: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows with the attributes of the version that held on their day; rows before a member's first version, after its
    last or without a member are left out, as in ``with_dim``.

    Versions and rows of a key are put in one order and the last version is carried forward, so there is no range
    condition to join on, and a key with many rows costs a sort.  A series is bounded by the calendar.
    """
    cols = [c for c in history.columns if c not in (key, FROM, TO)] if cols is None else list(cols)
    day = F.col(ts).cast("date")
    rows = fact.select(F.col(key).alias("_key"), day.alias("_day"), F.lit(1).alias("_is_row"), F.struct(*fact.columns).alias("_row"), F.lit(None).cast("date").alias("_to"))
    attrs = F.struct(*cols).alias("_attrs")
    rows = rows.withColumn("_attrs", F.lit(None).cast(history.select(attrs).schema["_attrs"].dataType))
    versions = history.select(
        F.col(key).alias("_key"),
        F.col(FROM).alias("_day"),
        F.lit(0).alias("_is_row"),
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
        F.coalesce(TO, F.lit("9999-12-31").cast("date")).alias("_to"),
        attrs,
    )
    in_order = Window.partitionBy("_key").orderBy("_day", "_is_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    holding = F.last(F.when(F.col("_is_row") == 0, F.struct("_to", "_attrs")), ignorenulls=True).over(in_order)
    filled = rows.unionByName(versions).filter(F.col("_key").isNotNull()).withColumn("_v", holding)
    held = filled.filter((F.col("_is_row") == 1) & (F.col("_day") < F.col("_v._to")))
    return held.select(F.col("_row.*"), *[F.col(f"_v._attrs.`{c}`").alias(c) for c in cols])
