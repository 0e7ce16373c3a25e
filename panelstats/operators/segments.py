"""The series operators for series too long for one task.

``split`` range-partitions a panel by key and time, so a long series is cut into several segments of
about equal size while short ones stay whole.  Windows then run per ``(key, segment)``, and what a
segment needs from those before it is brought along:

* running results (forward fill, first price, running maximum) as one *carried* row per segment,
* trailing frames as a *halo*: copies of the last rows before the segment,
* whole-series statistics from an aggregation over the cut series only.

A range partition holds parts of at most two cut series, the one it continues and the one it leaves
open.  Carried rows and statistics are therefore at most twice as many as partitions, whatever the
size of the data, and that is what makes it safe to broadcast them.

Bars without a time are dropped where raw bars come in; ``split`` itself fails on one.  ``partitions`` says
how many segments a panel has in all, so it decides the size of one: state it for large panels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import change, first_by, last_by, ratio, volume_outlier_flag
from ..spec import PanelSpec, in_order, so_far, whole_series
from .quality import cast_bars, dedup, drop_unfilled, timed
from .series import moving_avg, rolling_vol

SEGMENT = "segment"
HALO = "_halo"


@dataclass(frozen=True)
class SegmentedPanel:
    """Rows with their segment, and the extents of the series that were cut.

    ``spans`` has ``(key, segment, rows)`` for every segment of every cut series.
    """

    rows: DataFrame
    spans: DataFrame
    spec: PanelSpec

    @property
    def part(self) -> list[str]:
        return [self.spec.key, SEGMENT]

    def unsegmented(self) -> DataFrame:
        return self.rows.drop(SEGMENT)


def split(
    df: DataFrame, spec: PanelSpec, path: str, partitions: int | None = None
) -> SegmentedPanel:
    """Cut a panel unique per ``(key, ts)`` into segments and store it under ``path``.

    The cuts come from sampling, so they are fixed by writing them down before anything depends on
    them.  ``partitions`` defaults to the shuffle partitions of the session.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = F.raise_error(F.lit(f"NULL {spec.ts} in a panel to be cut"))
    timed = df.withColumn(spec.ts, F.coalesce(spec.ts, missing.cast(df.schema[spec.ts].dataType)))
    cut = timed.repartitionByRange(n, spec.key, spec.ts).withColumn(SEGMENT, F.spark_partition_id())
    return _store(cut, spec, path)


def fill_and_index(panel: SegmentedPanel, path: str, seeds: DataFrame | None = None) -> SegmentedPanel:
    """Forward fill, drop of unfillable rows, return and rebased price; stored under ``path``.

    ``seeds`` has, per key and segment, what the series had before this panel: its first price (``_seed_start``) and
    the last value of each measure (``_seed_<measure>``).
    """
    spec, part = panel.spec, panel.part
    wanted = [f"_seed_{c}" for c in (*spec.measures, "start")]
    carried = _carry(
        panel,
        {c: (last_by(c, spec.ts), lambda v: F.last(v, ignorenulls=True)) for c in spec.measures}
        | {"start": (first_by(spec.close, spec.ts), lambda v: F.first(v, ignorenulls=True))},
    )
    running = so_far(part, spec.ts)
    if seeds is None:
        rows = panel.rows.withColumns({c: F.lit(None).cast("double") for c in wanted})
    else:
        rows = panel.rows.join(seeds.select(*part, *wanted), part, "left")
    filled = rows.join(F.broadcast(carried), part, "left").withColumns(
        {
            c: F.coalesce(F.last(c, ignorenulls=True).over(running), f"_carried_{c}", F.col(f"_seed_{c}").cast(rows.schema[c].dataType))
            for c in spec.measures
        }
    )
    kept = drop_unfilled(filled, spec.close)
    before = F.coalesce(
        F.lag(spec.close).over(in_order(part, spec.ts)), f"_carried_{spec.close}", f"_seed_{spec.close}"
    )
    start = F.coalesce("_seed_start", "_carried_start", F.first(spec.close, ignorenulls=True).over(running))
    indexed = kept.withColumns(
        {
            "daily_return": change(spec.close, before),
            "close_norm": ratio(spec.close, start) * spec.base,
        }
    )
    return _store(indexed.drop(*wanted, *[c for c in indexed.columns if c.startswith("_carried_")]), spec, path)


def segmented_zscores(panel: SegmentedPanel, wanted: dict[str, str]) -> SegmentedPanel:
    """Whole-series z-scores (``output name -> column``), equal to those of uncut series."""
    spec, part = panel.spec, panel.part
    local = whole_series(part)
    cut = panel.spans.select(spec.key).distinct()
    stats = (
        panel.rows.join(F.broadcast(cut), spec.key, "left_semi")
        .groupBy(spec.key)
        .agg(
            *[F.avg(c).alias(f"_mean_{c}") for c in wanted.values()],
            *[F.stddev_samp(c).alias(f"_dev_{c}") for c in wanted.values()],
        )
    )
    rows = panel.rows.join(F.broadcast(stats), spec.key, "left").withColumns(
        {
            out: ratio(
                F.col(c) - F.coalesce(f"_mean_{c}", F.avg(c).over(local)),
                F.coalesce(f"_dev_{c}", F.stddev_samp(c).over(local)),
            )
            for out, c in wanted.items()
        }
    )
    helpers = [f"_{stat}_{c}" for stat in ("mean", "dev") for c in wanted.values()]
    return SegmentedPanel(rows.drop(*helpers), panel.spans, spec)


def segmented_index(
    raw: DataFrame, spec: PanelSpec, path: str, partitions: int | None = None
) -> SegmentedPanel:
    """Raw bars to clean, cut series with return and rebased price; stored under ``path``."""
    unique = dedup(timed(cast_bars(raw, spec), spec), spec.grid, latest=spec.version)
    return fill_and_index(split(unique, spec, f"{path}/unique", partitions), f"{path}/indexed")


def segmented_staging(
    raw: DataFrame, spec: PanelSpec, path: str, partitions: int | None = None
) -> SegmentedPanel:
    """``build_staging`` for series of any length; it is stored under ``path`` with what led to it."""
    scored = segmented_zscores(
        segmented_index(raw, spec, path, partitions),
        {"volume_zscore": spec.volume, "return_zscore": "daily_return"},
    )
    flag = volume_outlier_flag("volume_zscore", spec.volume_outlier_z)
    staging = f"{path}/staging"
    scored.rows.withColumn("is_volume_outlier", flag).write.mode("overwrite").parquet(staging)
    return SegmentedPanel(raw.sparkSession.read.parquet(staging), scored.spans, spec)


def reach_of(spec: PanelSpec) -> int:
    """Rows before a row that its frames reach back to."""
    return max(*spec.sma_frames, spec.vol_frame) - 1


def segmented_rolling(
    panel: SegmentedPanel, keep_segment: bool = False, seeds: DataFrame | None = None, tails: DataFrame | None = None
) -> DataFrame:
    """``rolling_fact`` for series of any length, from rows with a return and a rebased price.

    Of series that began before this panel, ``seeds`` has their peak (``_seed_peak``) per key and segment, and
    ``tails`` their last rows for each segment that frames reach out of.
    """
    spec, part, ts, price = panel.spec, panel.part, panel.spec.ts, panel.spec.close
    peaks = _carry(panel, {"peak": (F.max(price), F.max)})
    measures = [price, "daily_return", "close_norm"]
    df = with_halo(panel, reach_of(spec), measures)
    if tails is not None:
        df = df.unionByName(tails.select(*spec.grid, *measures, SEGMENT, F.lit(True).alias(HALO)))
    df = df.join(F.broadcast(peaks), part, "left")
    seed = F.lit(None).cast("double")
    if seeds is not None:
        df, seed = df.join(seeds.select(*part, "_seed_peak"), part, "left"), F.col("_seed_peak")
    peak = F.greatest(F.max(price).over(so_far(part, ts)), F.col("_carried_peak"), seed)
    df = df.withColumn("_peak", peak)
    for rows in spec.sma_frames:
        df = moving_avg(df, part, ts, price, rows)
    df = rolling_vol(
        df, part, ts, "daily_return", spec.vol_frame, spec.periods_per_year, out=spec.volatility
    )
    return (
        df.withColumn("drawdown", change(price, "_peak"))
        .filter(~F.col(HALO))
        .drop(price, HALO, "_peak", "_carried_peak", "_seed_peak", *([] if keep_segment else [SEGMENT]))
    )


def with_halo(panel: SegmentedPanel, reach: int, cols: list[str]) -> DataFrame:
    """Rows plus, flagged, copies of the ``reach`` rows before each segment of a cut series.

    A segment shorter than ``reach`` lets older segments through, so a halo may come from several of
    them.  Each segment sends at most its last ``reach`` rows.
    """
    spec, key = panel.spec, panel.spec.key
    by_segment = Window.partitionBy(key).orderBy(SEGMENT)
    earlier = by_segment.rowsBetween(Window.unboundedPreceding, -1)
    extents = panel.spans.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    following = F.collect_list(F.struct(SEGMENT, "start")).over(by_segment.rowsBetween(1, reach))
    targets = (
        extents.select(key, SEGMENT, (F.col("start") + F.col("rows")).alias("end"), following.alias("next"))
        .withColumn("to", F.explode("next"))
        .filter(F.col("to.start") - F.col("end") < reach)
        .select(key, SEGMENT, F.col(f"to.{SEGMENT}").alias("to"))
    )
    rows = panel.rows.select(*spec.grid, *cols, SEGMENT)
    from_end = Window.partitionBy(panel.part).orderBy(F.col(spec.ts).desc())
    senders = targets.select(*panel.part).distinct()
    tails = (
        rows.join(F.broadcast(senders), panel.part, "left_semi")
        .withColumn("_from_end", F.row_number().over(from_end))
        .filter(F.col("_from_end") <= reach)
        .drop("_from_end")
    )
    halo = (
        tails.join(F.broadcast(targets), panel.part)
        .drop(SEGMENT)
        .withColumnRenamed("to", SEGMENT)
    )
    return rows.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))


def _carry(panel: SegmentedPanel, wanted: dict[str, tuple[Column, object]]) -> DataFrame:
    """What the earlier segments of a cut series pass on, one row per segment.

    ``wanted`` maps a name to its aggregate within a segment and the aggregate over those results.
    """
    own = (
        panel.rows.join(F.broadcast(panel.spans.select(*panel.part)), panel.part, "left_semi")
        .groupBy(*panel.part)
        .agg(*[within.alias(name) for name, (within, _) in wanted.items()])
    )
    earlier = (
        Window.partitionBy(panel.spec.key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    )
    return own.select(
        *panel.part,
        *[across(name).over(earlier).alias(f"_carried_{name}") for name, (_, across) in wanted.items()],
    )


def _store(rows: DataFrame, spec: PanelSpec, path: str) -> SegmentedPanel:
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    stored = spark.read.parquet(f"{path}/rows")
    extents = stored.groupBy(spec.key, SEGMENT).agg(F.count("*").alias("rows"))
    segments = F.count("*").over(Window.partitionBy(spec.key))
    spans = extents.withColumn("_segments", segments).filter("_segments > 1").drop("_segments")
    spans.write.mode("overwrite").parquet(f"{path}/spans")
    return SegmentedPanel(stored, spark.read.parquet(f"{path}/spans"), spec)
