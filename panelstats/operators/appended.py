"""Series of any length that grow by appended days.

What a series passes on to its later days is small: its first price, its peak, the last value of each measure, its
last 251 rows, and the moments (count, mean, sum of squared deviations) of volume and return.  That state is stored
per series, and a delivery of later days starts from it: stored rows are not read.  Moments merge, but change the
z-scores of old rows, so they are kept apart from rows and joined when z-scores are read.

A delivery is cut into segments like any panel of long series.  State meets rows by key and segment, so a series
that has most rows of a delivery is spread over tasks.

Bars at or before the last time of their series come too late for this; they are written to a zone of their own
(``late``) and change nothing.  A delivery counts once its marker is written; one that failed is overwritten by the
next call.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_by, last_by, ratio, volume_outlier_flag
from ..sources.schema import place
from ..spec import PanelSpec
from .quality import cast_bars, dedup, timed
from .segments import SEGMENT, SegmentedPanel, _store, fill_and_index, reach_of, segmented_rolling, split

DELIVERY = "delivery"
_DONE = "_done-"


@dataclass
class AppendedPanel:
    """A panel under ``root`` that deliveries are appended to; ``partitions`` as in ``segments.split``."""

    spark: SparkSession
    root: str
    spec: PanelSpec = field(default_factory=PanelSpec)
    partitions: int | None = None

    def deliveries(self) -> int:
        """How many deliveries are complete."""
        files, at = place(self.spark, f"{self.root}/{_DONE}*")
        return len(files.globStatus(at) or [])

    def _at(self, zone: str, number: int) -> str:
        return f"{self.root}/{zone}/{DELIVERY}={number}"

    def append(self, raw: DataFrame) -> int:
        """Take in later bars of any series; returns the number of the delivery."""
        spec, number = self.spec, self.deliveries()
        work = f"{self.root}/work/{DELIVERY}={number}"
        unique = dedup(timed(cast_bars(raw, spec), spec), spec.grid, latest=spec.version)
        cut = split(unique, spec, f"{work}/unique", self.partitions)
        seeds = self._seeds(cut, number)
        marked = cut.rows.join(seeds.select(*cut.part, "_seed_ts"), cut.part, "left")
        is_late = F.coalesce(F.col(spec.ts) <= F.col("_seed_ts"), F.lit(False))
        marked.filter(is_late).drop(SEGMENT, "_seed_ts").write.mode("overwrite").parquet(self._at("late", number))
        on_time = _store(marked.filter(~is_late).drop("_seed_ts"), spec, f"{work}/on_time")
        indexed = fill_and_index(on_time, f"{work}/indexed", seeds)
        extents = self._extents(indexed)
        rolling = segmented_rolling(indexed, keep_segment=True, seeds=seeds, tails=self._tails(extents, seeds))
        for zone, rows in (("rows", indexed.rows), ("rolling", rolling)):
            placed = rows.hint("rebalance", spec.key, SEGMENT).sortWithinPartitions(*spec.grid)
            placed.write.mode("overwrite").parquet(self._at(zone, number))
        extents.select(*indexed.part).write.mode("overwrite").parquet(self._at("extents", number))
        self._next_state(on_time.rows, indexed.rows, number).write.mode("overwrite").parquet(self._at("state", number))
        files, done = place(self.spark, f"{self.root}/{_DONE}{number:08d}")
        files.createNewFile(done)
        return number

    # State

    def state(self, number: int | None = None) -> DataFrame | None:
        """One row per series after a delivery (the last one)."""
        number = self.deliveries() - 1 if number is None else number
        return None if number < 0 else self.spark.read.parquet(self._at("state", number))

    def _seeds(self, cut: SegmentedPanel, number: int) -> DataFrame:
        """State per key and segment of a delivery, NULL for new series."""
        spec, parts, before = self.spec, cut.rows.select(*cut.part).distinct(), self.state(number - 1)
        if before is None:
            kinds = {"ts": spec.ts_type.simpleString(), "start": "double", "peak": "double", "tail": self._tail_type()}
            kinds |= {c: "double" for c in spec.prices} | {spec.volume: "long"}
            return parts.withColumns({f"_seed_{c}": F.lit(None).cast(t) for c, t in kinds.items()})
        named = {"ts": "last_seen", "start": "start", "peak": "peak", "tail": "tail"} | {c: f"last_{c}" for c in spec.measures}
        return parts.join(before.select(spec.key, *[F.col(c).alias(f"_seed_{n}") for n, c in named.items()]), spec.key, "left")

    def _tail_type(self) -> str:
        return f"array<struct<{self.spec.ts}: {self.spec.ts_type.simpleString()}, {self.spec.close}: double, daily_return: double, close_norm: double>>"

    def _extents(self, panel: SegmentedPanel) -> DataFrame:
        """Every segment with the number of its series' rows before it."""
        earlier = Window.partitionBy(self.spec.key).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
        rows = panel.rows.groupBy(*panel.part).agg(F.count("*").alias("rows"))
        return rows.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))

    def _tails(self, extents: DataFrame, seeds: DataFrame) -> DataFrame:
        """The last stored rows of each series, for the segments whose frames reach back to them."""
        key, reach = self.spec.key, reach_of(self.spec)
        near = extents.filter(F.col("before") < reach).select(key, SEGMENT)
        return near.join(seeds.select(key, SEGMENT, "_seed_tail"), [key, SEGMENT]).select(key, SEGMENT, F.inline("_seed_tail"))

    def _next_state(self, on_time: DataFrame, indexed: DataFrame, number: int) -> DataFrame:
        """State after a delivery: that before it, merged with what the delivery adds."""
        spec, key, ts, reach = self.spec, self.spec.key, self.spec.ts, reach_of(self.spec)
        seen = on_time.groupBy(key).agg(F.max(ts).alias("last_seen"), *[last_by(c, ts).alias(f"last_{c}") for c in spec.measures])
        moments = [
            m
            for c in (spec.volume, "daily_return")
            for m in (F.count(c).alias(f"{c}_n"), F.avg(c).alias(f"{c}_mean"), (F.var_pop(c) * F.count(c)).alias(f"{c}_m2"))
        ]
        kept = indexed.groupBy(key).agg(
            F.min(ts).alias("first_date"),
            F.max(ts).alias("last_date"),
            F.count("*").alias("days"),
            first_by(spec.close, ts).alias("start"),
            F.max(spec.close).alias("peak"),
            *moments,
        )
        from_end = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc()))
        last = indexed.select(key, ts, spec.close, "daily_return", "close_norm").withColumn("_from_end", from_end)
        last = last.filter(F.col("_from_end") <= reach)
        tail = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(ts, spec.close, "daily_return", "close_norm"))).alias("tail"))
        fresh = seen.join(kept, key, "left").join(tail, key, "left")
        fresh = fresh.withColumn("tail", F.coalesce(F.col("tail").cast(self._tail_type()), F.array().cast(self._tail_type())))
        before = self.state(number - 1)
        if before is None:
            return fresh
        old, new = before.alias("old"), fresh.alias("new")
        both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full")

        def later(c: str):
            return F.coalesce(f"new.{c}", f"old.{c}").alias(c)

        def merged(c: str) -> list:
            n0, n1 = (F.coalesce(f"{side}.{c}_n", F.lit(0)) for side in ("old", "new"))
            m0, m1 = (F.coalesce(f"{side}.{c}_mean", F.lit(0.0)) for side in ("old", "new"))
            q0, q1 = (F.coalesce(f"{side}.{c}_m2", F.lit(0.0)) for side in ("old", "new"))
            n = n0 + n1
            mean = ratio(n0 * m0 + n1 * m1, n)
            return [n.alias(f"{c}_n"), mean.alias(f"{c}_mean"), (q0 + q1 + F.coalesce(ratio((m1 - m0) * (m1 - m0) * n0 * n1, n), F.lit(0.0))).alias(f"{c}_m2")]

        none = F.array().cast(self._tail_type())
        joint = F.concat(F.coalesce("old.tail", none), F.coalesce("new.tail", none))
        return both.select(
            F.coalesce(f"old.{key}", f"new.{key}").alias(key),
            later("last_seen"),
            *[later(f"last_{c}") for c in spec.measures],
            F.least("old.first_date", "new.first_date").alias("first_date"),
            later("last_date"),
            (F.coalesce("old.days", F.lit(0)) + F.coalesce("new.days", F.lit(0))).alias("days"),
            F.coalesce("old.start", "new.start").alias("start"),
            F.greatest("old.peak", "new.peak").alias("peak"),
            *merged(spec.volume),
            *merged("daily_return"),
            F.slice(joint, F.greatest(F.size(joint) - reach + 1, F.lit(1)), reach).alias("tail"),
        )

    # Reading

    def _zone(self, zone: str) -> DataFrame:
        """A zone's complete deliveries."""
        paths = [self._at(zone, i) for i in range(self.deliveries())]
        return self.spark.read.option("basePath", f"{self.root}/{zone}").parquet(*paths)

    def rolling(self) -> DataFrame:
        return self._zone("rolling").drop(DELIVERY, SEGMENT)

    def staging(self) -> DataFrame:
        """All rows with z-scores by the moments of now."""
        spec, wanted = self.spec, {"volume_zscore": self.spec.volume, "return_zscore": "daily_return"}
        part = [spec.key, DELIVERY, SEGMENT]
        moments = self.state().select(spec.key, *[f"{c}_{m}" for c in wanted.values() for m in ("n", "mean", "m2")])
        by_part = self._zone("extents").select(*part).join(moments, spec.key)
        rows = self._zone("rows").join(by_part, part)
        scored = rows.withColumns(
            {z: ratio(F.col(c) - F.col(f"{c}_mean"), F.sqrt(ratio(f"{c}_m2", F.nullif(F.col(f"{c}_n") - 1, F.lit(0))))) for z, c in wanted.items()}
        )
        flag = volume_outlier_flag("volume_zscore", spec.volume_outlier_z)
        return scored.withColumn("is_volume_outlier", flag).drop(DELIVERY, SEGMENT, *[f"{c}_{m}" for c in wanted.values() for m in ("n", "mean", "m2")])

    def series(self) -> DataFrame:
        """Dates, days and average volume of every series, from the state alone."""
        mean = F.round(f"{self.spec.volume}_mean", 0).alias("avg_daily_volume")
        days = F.col("days").alias("trading_days")
        return self.state().filter(F.col("days") > 0).select(self.spec.key, "first_date", "last_date", days, mean)

    def late(self) -> DataFrame:
        """Bars that came too late."""
        return self._zone("late").drop(DELIVERY)
