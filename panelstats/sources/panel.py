"""Reading panels and shaping vendor frames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import DAY, PanelSpec
from .schema import stored_schema

# Columns of the published dimension.
DIM_COLUMNS = ("ticker", "etf_name", "provider", "category", "index_tracked", "currency", "exchange")


def read_panel(
    spark: SparkSession,
    path: str,
    spec: PanelSpec = PanelSpec(),
    schema: T.StructType | None = None,
    rebase: str = "CORRECTED",
) -> DataFrame:
    """Read a Parquet tree laid out as ``<path>/<key>=<value>/``.

    Without ``schema`` the one stored with the tree is used; where there is none the footers are merged, which
    touches every file.
    The key is always read as text, so ``007`` and ``1e5`` survive the directory name.  ``rebase``
    applies to legacy INT96 and pre-Gregorian dates.
    """

    def reader():
        return (
            spark.read.option("basePath", path)
            .option("datetimeRebaseMode", rebase)
            .option("int96RebaseMode", rebase)
        )

    schema = schema or stored_schema(spark, path)
    if schema is None:
        schema = reader().option("mergeSchema", True).parquet(path).schema
    text_key = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == spec.key else f.dataType) for f in schema.fields]
    )
    return reader().schema(text_key).parquet(path)


def read_zone(spark: SparkSession, path: str) -> DataFrame:
    """Read a zone back by its stored schema, or that of a footer; partition directories are discovered."""
    schema = stored_schema(spark, path)
    return spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)


def dim_from_rows(
    spark: SparkSession, rows: Iterable[tuple], columns: Iterable[str] = DIM_COLUMNS
) -> DataFrame:
    """A small dimension given as literal rows of text."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.createDataFrame(list(rows), schema)


def normalize_bars(
    df: DataFrame,
    spec: PanelSpec = PanelSpec(),
    asof: dt.date | str | None = None,
    names: DataFrame | None = None,
    exchange_tz: str | None = None,
    keep: Sequence[str] = (),
    zone: str | None = None,
) -> DataFrame:
    """Shape a vendor frame into raw bars.

    Column names are lower-cased and their spaces become underscores; columns outside the bar are
    dropped unless in ``keep``.  An instant is turned into wall time, then truncated to milliseconds: that of
    the instrument's own zone if ``names`` has one in its column ``zone``, else of ``exchange_tz``, else of
    the session.  ``names`` (key, display name) adds the display name, and ``asof`` the ingestion date as
    ISO text.
    """
    renamed = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    own = F.lit(None).cast("string")
    if names is not None:
        extra = [F.col(spec.name).alias("_name")] + ([F.col(zone).alias("_zone")] if zone else [])
        own = F.col("_zone") if zone else own
        renamed = renamed.join(names.select(spec.key, *extra), spec.key, "left")
    wall = F.col(spec.ts)
    if isinstance(renamed.schema[spec.ts].dataType, T.TimestampType):
        here = F.current_timezone()
        to = F.coalesce(own, F.lit(exchange_tz), here)
        wall = F.convert_timezone(here, to, wall.cast("timestamp_ntz"))
    bars = renamed.select(
        F.date_trunc("millisecond", wall).cast("timestamp_ntz").alias(spec.ts),
        *[c for c in renamed.columns if c in {*spec.measures, spec.key}],
        *([spec.name] if names is None and spec.name in renamed.columns else []),
        F.lit(None if asof is None else str(asof)).cast("string").alias(spec.version),
        *keep,
        *([F.col("_name").alias(spec.name)] if names is not None else []),
    )
    return bars


def clip_history(
    df: DataFrame,
    start: dt.date | str,
    end: dt.date | str,
    spec: PanelSpec = PanelSpec(),
) -> DataFrame:
    """Rows with ``start <= ts < end``: the whole history up to, not including, the run date."""
    as_ts = (lambda v: F.lit(str(v)).cast("date" if spec.grain == DAY else "timestamp_ntz"))
    return df.filter((F.col(spec.ts) >= as_ts(start)) & (F.col(spec.ts) < as_ts(end)))
