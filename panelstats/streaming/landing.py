"""Taking in newly landed vendor files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.panel import normalize_bars
from ..sources.sinks import replace_keys
from ..spec import PanelSpec

LANDED = "_landed"


def newest_files(bars: DataFrame, spec: PanelSpec) -> DataFrame:
    """Of each key the bars of the file that landed last; one key of very many bars is only joined."""
    last = bars.groupBy(F.col(spec.key).alias("_key")).agg(F.max(LANDED).alias("_last"))
    of_key = F.col(spec.key).eqNullSafe(F.col("_key")) & (F.col(LANDED) == F.col("_last"))
    return bars.join(last, of_key, "left_semi")


def ingest_landed(
    spark: SparkSession,
    landing: str,
    raw: str,
    checkpoint: str,
    schema: T.StructType,
    asof: dt.date | str,
    spec: PanelSpec = PanelSpec(),
    names: DataFrame | None = None,
    exchange_tz: str | None = None,
    buckets: int | None = None,
    zone: str | None = None,
) -> None:
    """Process every file that landed since the last run, then stop.

    The stream remembers the files it has seen, so a rerun after a failure takes each file once, and
    ``replace_keys`` makes a repeated batch harmless.  A file carries the whole history of its keys: the
    newest file that has a key replaces what older ones have of it, whether they come in the same batch
    or in different ones.
    """

    def take(batch: DataFrame, _: int) -> None:
        bars = normalize_bars(batch, spec, asof, names, exchange_tz, keep=[LANDED], zone=zone)
        replace_keys(newest_files(bars, spec).drop(LANDED), raw, spec, buckets)

    (
        spark.readStream.schema(schema)
        .parquet(landing)
        .withColumn(LANDED, F.struct("_metadata.file_modification_time", "_metadata.file_path"))
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
