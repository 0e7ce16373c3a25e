"""Reconciling an arriving batch with the registry of expected keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import PanelSpec

# Key states and run status codes.
PROCESSED, FAILED = "processed", "failed"
OK, ERROR = 200, 500


def ingest_status(batch: DataFrame, registry: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """One row per registered key: rows received and whether that makes it processed or failed."""
    received = batch.groupBy(spec.key).agg(F.count("*").alias("rows"))
    return (
        registry.select(spec.key)
        .join(received, spec.key, "left")
        .withColumns(
            {
                "rows": F.coalesce("rows", F.lit(0)),
                "status": F.when(F.col("rows") > 0, PROCESSED).otherwise(FAILED),
            }
        )
    )


def ingest_summary(
    batch: DataFrame, registry: DataFrame, run_date: dt.date | str, spec: PanelSpec = PanelSpec()
) -> DataFrame:
    """One row per run: status code (200 if any key arrived, else 500), counts and a JSON body of them.

    The body is the same at every size; ``ingest_status`` has the keys, one row each.
    """
    status = ingest_status(batch, registry, spec)
    counts = status.agg(
        F.count_if(F.col("status") == PROCESSED).alias("n_processed"),
        F.count_if(F.col("status") == FAILED).alias("n_failed"),
    )
    return counts.withColumn("run_date", F.lit(str(run_date))).select(
        "run_date",
        F.when(F.col("n_processed") > 0, OK).otherwise(ERROR).alias("status_code"),
        "n_processed",
        "n_failed",
        F.to_json(F.struct("run_date", "n_processed", "n_failed")).alias("body"),
    )
