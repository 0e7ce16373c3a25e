"""Facts placed for slices by day as well as by series.

Facts sorted by series and day have row groups that span the whole history, so a range of days prunes nothing; sorted
by day alone, a series is spread over all files.  Here rows are ordered by the interleaved bits of the day and of a
hash of the key and range-partitioned by that order.  A row group then covers a short range of days and a part of the
keys, and its statistics of both let a scan skip it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..spec import PanelSpec
from .schema import store_schema

#: Column with the hash of the key that is stored beside it.
KEY_HASH = "key_hash"
#: Bits of the key's hash and of a day's share of the history; days come in shorter ranges, so some of theirs lead.
KEY_BITS = DAY_BITS = 16
LEAD = 2
_PLACE = "_place"


def day_number(c: Column | str) -> Column:
    return F.datediff(c, F.lit("1970-01-01").cast("date"))


def interleaved(day: Column, key: Column, day_bits: int, key_bits: int = KEY_BITS, lead: int = 0) -> Column:
    """The bits of a number of ``day_bits`` and of one of ``key_bits``: ``lead`` of the day's, then in turns, highest first."""
    left = {0: day_bits, 1: key_bits}
    turns = [0] * min(lead, day_bits) + [0, 1] * max(day_bits, key_bits)
    out, place = F.lit(0).cast("long"), day_bits + key_bits
    for i in turns:
        if left[i]:
            left[i] -= 1
            place -= 1
            bit = F.shiftright((day, key)[i].cast("long"), left[i]).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, place))
    return out


def write_interleaved(
    df: DataFrame, path: str, spec: PanelSpec = PanelSpec(), files: int | None = None, row_group: int | None = None
) -> DataFrame:
    """Overwrite a fact in the interleaved order and return it as read back, with the hash of its keys.

    ``files`` is the number of range partitions (the session's shuffle partitions by default), ``row_group`` the bytes
    of a row group.  A slice of days reads about its share of them, or the square root of their number if that
    is more.  Rows without a day come first.
    """
    spark = df.sparkSession
    days = df.agg(F.min(day_number(spec.ts)).alias("low"), F.max(day_number(spec.ts)).alias("high")).first()
    low = days["low"] or 0
    share = F.lit(((1 << DAY_BITS) - 1) / max(1, (days["high"] or 0) - low))
    number = F.pmod(F.hash(spec.key), F.lit(1 << KEY_BITS)).cast("int")
    placed = df.withColumn(KEY_HASH, number)
    day = F.floor(F.coalesce(day_number(spec.ts) - low, F.lit(0)) * share)
    placed = placed.withColumn(_PLACE, interleaved(day, F.col(KEY_HASH), DAY_BITS, KEY_BITS, LEAD))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(n, _PLACE, spec.key, spec.ts).sortWithinPartitions(_PLACE, spec.key, spec.ts).drop(_PLACE)
    writer = placed.write.mode("overwrite")
    if row_group:
        writer = writer.option("parquet.block.size", row_group)
    writer.parquet(path)
    schema = df.withColumn(KEY_HASH, number).schema
    store_schema(spark, path, schema)
    return spark.read.schema(schema).parquet(path)


def slice_of(
    fact: DataFrame,
    spec: PanelSpec = PanelSpec(),
    first: dt.date | str | None = None,
    last: dt.date | str | None = None,
    keys: Iterable[str] | None = None,
) -> DataFrame:
    """Rows of an interleaved fact from ``first`` up to, not including, ``last``, and of some keys; without the hash.

    The conditions are plain comparisons on stored columns, so they reach the row groups' statistics.
    """
    for day, compare in ((first, F.col(spec.ts).__ge__), (last, F.col(spec.ts).__lt__)):
        if day is not None:
            fact = fact.filter(compare(F.lit(str(day)).cast("date")))
    if keys is not None:
        keys = list(keys)
        fact = fact.filter(F.col(KEY_HASH).isin(key_hashes(fact.sparkSession, keys)) & F.col(spec.key).isin(keys))
    return fact.drop(KEY_HASH)


def key_hashes(spark: SparkSession, keys: list[str]) -> list[int]:
    """The stored hashes of some keys."""
    if not keys:
        return []
    rows = spark.createDataFrame([(k,) for k in keys], "k string")
    return sorted({r[0] for r in rows.select(F.pmod(F.hash("k"), F.lit(1 << KEY_BITS)).cast("int")).collect()})
