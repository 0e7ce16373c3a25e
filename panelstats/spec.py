"""Column mapping, frame lengths and thresholds shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec
from pyspark.sql import types as T

DAY = "day"
INSTANT = "instant"


@dataclass(frozen=True)
class PanelSpec:
    """Describes a keyed panel: one row per ``(key, ts)``.

    ``grain="day"`` stores ``ts`` as a date.  Once ``dedup`` has run, a series then has at most one
    row per calendar date, so a window over a whole series is bounded by the calendar, whatever the
    size of the panel.  ``grain="instant"`` stores a timestamp, a series has no such bound, and the
    operators of :mod:`panelstats.operators.segments` take over.
    """

    key: str = "ticker"
    ts: str = "date"
    open: str = "open"
    high: str = "high"
    low: str = "low"
    close: str = "close"
    volume: str = "volume"
    name: str = "etf_name"
    version: str = "ingestion_date"
    category: str = "category"
    provider: str = "provider"
    grain: str = DAY

    # Frame lengths, thresholds and base of the published indicators.
    sma_frames: tuple[int, ...] = (20, 252)
    vol_frame: int = 30
    periods_per_year: int = 252
    base: float = 100.0
    anomaly_z: float = 2.5
    high_z: float = 3.0
    extreme_z: float = 4.0
    volume_outlier_z: float = 3.0
    high_volume_z: float = 2.0
    bucket_width: float = 0.5
    trend_tolerance: float = 1e-12

    def __post_init__(self) -> None:
        if self.grain not in (DAY, INSTANT):
            raise ValueError(f"grain must be {DAY!r} or {INSTANT!r}, not {self.grain!r}")

    @property
    def grid(self) -> list[str]:
        return [self.key, self.ts]

    @property
    def prices(self) -> list[str]:
        return [self.open, self.high, self.low, self.close]

    @property
    def measures(self) -> list[str]:
        return [*self.prices, self.volume]

    @property
    def volatility(self) -> str:
        return f"volatility_{self.vol_frame}_annualized"

    @property
    def trend_sma(self) -> str:
        """The longest moving average, which the trend signal compares with the close."""
        return sma_name(max(self.sma_frames))

    @property
    def ts_type(self) -> T.DataType:
        return T.DateType() if self.grain == DAY else T.TimestampNTZType()

    def bar_schema(self) -> T.StructType:
        """Canonical bar: what ``cast_bars`` yields and ``read_panel`` may be given."""
        return T.StructType(
            [T.StructField(self.ts, self.ts_type)]
            + [T.StructField(c, T.DoubleType()) for c in self.prices]
            + [
                T.StructField(self.volume, T.LongType()),
                T.StructField(self.key, T.StringType()),
                T.StructField(self.name, T.StringType()),
                T.StructField(self.version, T.StringType()),
            ]
        )


def sma_name(n: int) -> str:
    return f"sma_{n}"


# Windows.  ``key`` is one column name or a list of them.


def whole_series(key: str | list[str]) -> WindowSpec:
    return Window.partitionBy(key)


def in_order(key: str | list[str], ts: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(ts)


def trailing(key: str | list[str], ts: str, rows: int) -> WindowSpec:
    """The current row and the ``rows - 1`` before it; early rows see a partial frame."""
    if rows < 1:
        raise ValueError("a trailing frame needs at least one row")
    return in_order(key, ts).rowsBetween(1 - rows, Window.currentRow)


def so_far(key: str | list[str], ts: str) -> WindowSpec:
    """Everything from the start of the series to the current row."""
    return in_order(key, ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
