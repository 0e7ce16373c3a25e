"""A star schema over series of any length: facts stored by key and segment."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.segments import SEGMENT, SegmentedPanel, segmented_rolling
from .star import anomaly_fact, build_dim, price_fact


def write_segmented_star(cut: SegmentedPanel, attrs: DataFrame, root: str) -> dict[str, DataFrame]:
    """Write dimension and facts below ``root`` and return them as read back.

    A task writes rows of some segments, never a whole long series, and the rebalancing splits what is
    still too large.  Facts keep their segment; they join on key and time, which Spark places by both.
    """
    spec = cut.spec
    facts = {
        "fact_prices": price_fact(cut.rows, spec, keep=[SEGMENT]),
        "fact_rolling": segmented_rolling(cut, keep_segment=True),
        "fact_anomalies": anomaly_fact(cut.rows, spec, keep=[SEGMENT]),
    }
    build_dim(attrs, cut.rows, spec).write.mode("overwrite").parquet(f"{root}/dim_etf")
    for name, fact in facts.items():
        placed = fact.hint("rebalance", spec.key, SEGMENT).sortWithinPartitions(spec.key, spec.ts)
        placed.write.mode("overwrite").parquet(f"{root}/{name}")
    spark = cut.rows.sparkSession
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("dim_etf", *facts)}
