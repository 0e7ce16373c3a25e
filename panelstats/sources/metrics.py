"""Row counts of a run, without a job per count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.quality import failed_casts
from ..spec import PanelSpec


class StageObserver:
    """Counts rows at marked points while a sink's own job runs.

    Pass one to ``build_staging``; after the write, ``report()`` returns plain numbers.  They describe
    the run, not the table: rows of a stage recomputed after losing an executor may be counted again.
    ``staging_metrics`` counts what is stored.
    """

    def __init__(self) -> None:
        self._points: dict[str, Observation] = {}

    def mark(self, df: DataFrame, point: str, flag: str | None = None) -> DataFrame:
        self._points[point] = Observation(point)
        metrics = [F.count(F.lit(1)).alias("rows")]
        if flag is not None:
            metrics.append(F.count_if(flag).alias(flag))
        return df.observe(self._points[point], *metrics)

    def report(self) -> dict[str, dict[str, int]]:
        return {point: seen.get for point, seen in self._points.items()}


def staging_metrics(raw: DataFrame, staging: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """``(metric, value)`` rows of the raw-to-staging step, from one pass over each zone for each kind.

    ``failed_casts`` counts values of raw bars that staging has as NULL; ``operators.quality.failed_casts``
    has them by column.
    """
    copies = raw.groupBy(*spec.grid).agg(F.count("*").alias("copies"))
    before = copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
    )
    after = staging.agg(
        F.count("*").alias("rows_after_fill"),
        F.count_if("is_volume_outlier").alias("volume_outliers"),
    )
    lost = failed_casts(raw, spec).agg(F.sum("failed").alias("failed_casts"))
    return _tall(before).unionByName(_tall(after)).unionByName(_tall(lost))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` of every given table."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def schema_report(df: DataFrame) -> list[tuple[str, str, bool]]:
    """Name, type and nullability of every column; nothing is executed."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def _tall(one_row: DataFrame) -> DataFrame:
    return one_row.unpivot([], one_row.columns, "metric", "value")
