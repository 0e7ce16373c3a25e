"""Raw bars to staging: clean rows with their basic indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scalars import volume_outlier_flag
from ..operators.quality import cast_bars, dedup, drop_unfilled, forward_fill, timed, zscores
from ..operators.series import rebase, simple_return
from ..sources.metrics import StageObserver
from ..spec import DAY, PanelSpec


def clean_bars(
    raw: DataFrame, spec: PanelSpec = PanelSpec(), observer: StageObserver | None = None
) -> DataFrame:
    """Typed, one row per key and time (the newest ingestion), gaps filled, unfillable rows dropped.

    Bars whose time is missing or can't be cast are dropped too; ``failed_casts`` counts the latter.
    """
    daily_only(spec)
    mark = observer.mark if observer else lambda df, point: df
    typed = mark(cast_bars(raw, spec), "raw")
    unique = mark(dedup(timed(typed, spec), spec.grid, latest=spec.version), "deduplicated")
    filled = forward_fill(unique, spec.key, spec.ts, spec.measures)
    return mark(drop_unfilled(filled, spec.close), "filled")


def add_indicators(clean: DataFrame, spec: PanelSpec = PanelSpec()) -> DataFrame:
    """Return, rebased price, volume and return z-scores, volume outlier flag.

    The ordered window functions come first and both z-scores share one pass, so the whole chain
    reuses a single exchange and sort by series.
    """
    daily_only(spec)
    with_return = simple_return(clean, spec.key, spec.ts, spec.close)
    rebased = rebase(with_return, spec.key, spec.ts, spec.close, spec.base)
    scored = zscores(
        rebased, spec.key, {"volume_zscore": spec.volume, "return_zscore": "daily_return"}
    )
    flag = volume_outlier_flag("volume_zscore", spec.volume_outlier_z)
    return scored.withColumn("is_volume_outlier", flag)


def build_staging(
    raw: DataFrame, spec: PanelSpec = PanelSpec(), observer: StageObserver | None = None
) -> DataFrame:
    staging = add_indicators(clean_bars(raw, spec, observer), spec)
    if observer:
        staging = observer.mark(staging, "staging", flag="is_volume_outlier")
    return staging


def daily_only(spec: PanelSpec) -> None:
    """Refuse series without a bounded length where a task takes a whole series."""
    if spec.grain != DAY:
        raise ValueError(
            "series of this grain have no bounded length: use panelstats.operators.segments"
        )
