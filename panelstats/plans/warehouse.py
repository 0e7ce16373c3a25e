"""The two batch steps as jobs over storage: raw zone to staging, staging to the star schema."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exchange_partitions
from ..sources.metrics import StageObserver
from ..sources.panel import read_panel, read_zone
from ..sources.sinks import (
    BUCKET,
    bucket_of,
    claim_buckets,
    exists,
    register_bucketed,
    register_views,
    replace_buckets,
    replace_keys,
    stored_buckets,
    write_dim,
    write_fact,
)
from ..spec import PanelSpec
from . import summaries, views
from .staging import build_staging, daily_only
from .star import anomaly_fact, build_dim, price_fact, rolling_fact

TABLES = ("dim_etf", "fact_prices", "fact_rolling", "fact_anomalies")


ZONES = ("staging", *TABLES)


@dataclass
class Warehouse:
    """Zones under one root.  Each ``write_*`` runs one job and returns the table read back.

    The number of buckets is a property of the warehouse: that of its first write (``buckets``, or the
    shuffle partitions of the session) is stored under the root and holds for all its tables and all later
    sessions.  ``open`` registers stored zones with a new catalog.  Series must have a bounded length;
    ``operators.segments`` stores others.

    With ``layout="hashed"`` every bucket is a directory of each zone, and a bucket of a zone depends on the same
    bucket of the zone before it only.  ``refresh`` takes a delivery through all zones: it reads and rewrites the
    buckets that receive a key, in raw, staging, dimension, facts and summaries, and no others.
    """

    spark: SparkSession
    root: str
    spec: PanelSpec = field(default_factory=PanelSpec)
    layout: str = "bucket"
    buckets: int | None = None

    def path(self, zone: str) -> str:
        return f"{self.root}/{zone}"

    def __post_init__(self) -> None:
        daily_only(self.spec)

    def table(self, zone: str) -> str:
        """Catalog name of a bucketed zone; the digest tells apart roots whose names look alike."""
        name = re.sub(r"\W+", "_", self.root.rstrip("/").rsplit("/", 1)[-1]).strip("_").lower()
        return f"{name}_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{zone}"

    def bucket_count(self) -> int:
        """The stored number of buckets; the first call stores it."""
        known = stored_buckets(self.spark, self.root)
        n = self.buckets or known or exchange_partitions(self.spark)
        claim_buckets(self.spark, self.root, n)
        return n

    def open(self) -> dict[str, DataFrame]:
        """The stored zones by name, their buckets known to this session's catalog."""
        found = {}
        for zone in ZONES:
            if not exists(self.spark, self.path(zone)):
                continue
            if self.layout in ("bucket", "hashed"):
                order = [self.spec.key] if zone == "dim_etf" else self.spec.grid
                found[zone] = register_bucketed(
                    self.spark, self.path(zone), self.table(zone), self.spec.key, order, self.bucket_count(), self.layout == "hashed"
                ).drop(BUCKET)
            else:
                found[zone] = read_zone(self.spark, self.path(zone))
        return found

    def write_staging(self, raw: DataFrame, observer: StageObserver | None = None) -> DataFrame:
        return self._fact(build_staging(raw, self.spec, observer), "staging")

    def write_star(self, staging: DataFrame, attrs: DataFrame) -> dict[str, DataFrame]:
        return {
            "dim_etf": self.write_dim(staging, attrs),
            "fact_prices": self.write_prices(staging),
            "fact_rolling": self.write_rolling(staging),
            "fact_anomalies": self.write_anomalies(staging),
        }

    def write_dim(self, staging: DataFrame, attrs: DataFrame) -> DataFrame:
        table = self.table("dim_etf") if self.layout in ("bucket", "hashed") else None
        dim = build_dim(attrs, staging, self.spec)
        buckets = self.bucket_count() if table else None
        return write_dim(dim, self.path("dim_etf"), self.spec.key, table, buckets, self.layout == "hashed").drop(BUCKET)

    def write_prices(self, staging: DataFrame) -> DataFrame:
        return self._fact(price_fact(staging, self.spec), "fact_prices")

    def write_rolling(self, staging: DataFrame) -> DataFrame:
        return self._fact(rolling_fact(staging, self.spec), "fact_rolling")

    def write_anomalies(self, staging: DataFrame) -> DataFrame:
        """The few rows left by the filter are gathered by key, not written as one sliver per task."""
        return self._fact(anomaly_fact(staging, self.spec), "fact_anomalies", clustered=False)

    def write_summaries(self, star: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The partial results that views and reports are merged from (see ``summaries``)."""
        n = self.bucket_count()
        for name, made in summaries.partials(star, self.spec, n).items():
            summaries.store(made, self.path(name), n)
        return self.summaries()

    def summaries(self) -> dict[str, DataFrame]:
        return {name: read_zone(self.spark, self.path(name)) for name in summaries.SUMMARIES}

    def refresh(self, arrivals: DataFrame, raw: str, attrs: DataFrame) -> list[int]:
        """Replace the histories of the arriving keys in the raw zone at ``raw`` and in every zone made from it.

        Returns the buckets that were touched.  A refresh that fails half-way is mended by running it again: zones
        are rewritten in order, and none depends on what it had in these buckets.
        """
        if self.layout != "hashed":
            raise ValueError("a refresh needs zones with a directory for each bucket")
        spec, n = self.spec, self.bucket_count()
        touched = replace_keys(arrivals, raw, spec, n)
        if not touched:
            return touched
        delivered = read_panel(self.spark, raw, spec).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
        self._replace(build_staging(delivered, spec), "staging", touched)
        staging = self.part("staging", touched)
        self._replace(build_dim(attrs.filter(bucket_of(spec.key, n).isin(touched)), staging, spec), "dim_etf", touched)
        self._replace(price_fact(staging, spec), "fact_prices", touched)
        self._replace(rolling_fact(staging, spec), "fact_rolling", touched)
        self._replace(anomaly_fact(staging, spec), "fact_anomalies", touched)
        if exists(self.spark, self.path(summaries.SUMMARIES[0])):
            star = {zone: self.part(zone, touched) for zone in TABLES}
            for name, made in summaries.partials(star, spec, n).items():
                summaries.store(made, self.path(name), n, touched)
        return touched

    def part(self, zone: str, buckets: list[int]) -> DataFrame:
        """Some buckets of a hashed zone; the scan is limited to their directories."""
        return self.spark.table(self.table(zone)).filter(F.col(BUCKET).isin(buckets)).drop(BUCKET)

    def _replace(self, df: DataFrame, zone: str, touched: list[int]) -> None:
        replace_buckets(df, self.path(zone), self.table(zone), self.spec.key, self.bucket_count(), touched)

    def _fact(self, df: DataFrame, zone: str, clustered: bool = True) -> DataFrame:
        """The full facts come out of a key window or a bucketed table, so they are clustered already."""
        bucketed = self.layout in ("bucket", "hashed")
        buckets = self.bucket_count() if bucketed else None
        ends = exchange_partitions(self.spark) == buckets
        return write_fact(
            df,
            self.path(zone),
            self.spec,
            layout=self.layout,
            table=self.table(zone) if bucketed else None,
            buckets=buckets,
            clustered=clustered and ends,
        ).drop(BUCKET)


def star_views(
    star: dict[str, DataFrame], spec: PanelSpec = PanelSpec(), ordered: bool = False
) -> dict[str, DataFrame]:
    """The eight named views over ``dim_etf``, ``fact_prices``, ``fact_rolling``, ``fact_anomalies``.

    A sorted view sorts its whole table whenever it is read, so that is left to exports and reports.
    """
    dim, prices, rolling, anomalies = (star[t] for t in TABLES)
    build: dict[str, Callable[[], DataFrame]] = {
        "v_prices_normalized": lambda: views.normalized_prices(prices, dim, spec, ordered),
        "v_category_performance": lambda: views.category_performance(prices, dim, spec, ordered),
        "v_category_volatility": lambda: views.category_volatility(rolling, dim, spec, ordered),
        "v_risk_return": lambda: views.risk_return(prices, rolling, dim, spec, ordered),
        "v_returns_daily": lambda: views.daily_returns(prices, spec, ordered),
        "v_volatility_heatmap": lambda: views.volatility_heatmap(prices, rolling, dim, spec, ordered),
        "v_drawdown_analysis": lambda: views.drawdown_analysis(prices, rolling, dim, spec, ordered),
        "v_anomalies_detail": lambda: views.anomaly_detail(anomalies, dim, spec, ordered),
    }
    return {name: make() for name, make in build.items()}


def publish(
    star: dict[str, DataFrame], spec: PanelSpec = PanelSpec(), ordered: bool = False
) -> dict[str, DataFrame]:
    """Register the four tables and the eight views under their names; returns the views."""
    made = star_views(star, spec, ordered)
    register_views({**star, **made})
    return made
