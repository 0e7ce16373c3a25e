"""Zones built once per session and data folder, in the shared folder of the cluster."""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from panelstats.plans.warehouse import Warehouse
from panelstats.session import colocate_joins, deal
from panelstats.shared import shared_folder
from panelstats.sources.panel import read_panel
from panelstats.sources.sinks import BUCKET, replace_keys
from panelstats.spec import PanelSpec

from . import market

_lock = threading.RLock()

#: Order lines whose bars are one partition, or one bucket, of a zone.
LINES = 400_000


class once:  # noqa: N801
    """A property computed on first use, by one thread."""

    def __init__(self, make) -> None:
        self.make, self.name = make, f"_{make.__name__}"

    def __get__(self, zones, _=None):
        with _lock:
            if self.name not in zones.__dict__:
                zones.__dict__[self.name] = self.make(zones)
            return zones.__dict__[self.name]


_zones: dict[tuple[str, str], Zones] = {}


class Zones:
    """Raw bars, staging and star schema of one data folder; each is written on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.spec = colocate_joins(spark), sf_dir, PanelSpec()
        tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:10]
        app = spark.sparkContext.applicationId
        self.root = f"{shared_folder(spark)}/panelstats/{app}/{tag}"
        self._scratch = 0

    def scratch(self, name: str) -> str:
        """A path nothing was written to yet."""
        with _lock:
            self._scratch += 1
            return f"{self.root}/scratch/{name}-{self._scratch}"

    @once
    def parts(self) -> int:
        """Partitions of an exchange by series, and buckets of a zone: as many as the order lines ask for.

        Exchanges begin with that many, so that what a task sorts doesn't grow with the tables; small ones are
        put together when they run.
        """
        lines = market.table(self.spark, self.sf_dir, "lineitem").count()  # from the footers
        return deal(self.spark, -(-lines // LINES))

    @once
    def warehouse(self) -> Warehouse:
        return Warehouse(self.spark, self.root, self.spec, buckets=self.parts)

    @once
    def raw(self) -> DataFrame:
        path = self.warehouse.path("raw")
        market.raw_bars(self.spark, self.sf_dir).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    @once
    def staging(self) -> DataFrame:
        return self.warehouse.write_staging(self.raw)

    @property
    def attrs(self) -> DataFrame:
        return market.attributes(self.spark, self.sf_dir)

    @once
    def dim(self) -> DataFrame:
        return self.warehouse.write_dim(self.staging, self.attrs)

    @once
    def prices(self) -> DataFrame:
        return self.warehouse.write_prices(self.staging)

    @once
    def rolling(self) -> DataFrame:
        return self.warehouse.write_rolling(self.staging)

    @once
    def anomalies(self) -> DataFrame:
        return self.warehouse.write_anomalies(self.staging)

    @once
    def refreshed(self) -> Warehouse:
        """Zones by bucket, with summaries, after one exchange delivered the histories of its instruments again."""
        house = Warehouse(self.spark, f"{self.root}/refreshed", self.spec, layout="hashed", buckets=self.parts)
        raw = house.path("raw")
        replace_keys(self.raw, raw, self.spec, house.bucket_count())
        star = house.write_star(house.write_staging(read_panel(self.spark, raw, self.spec).drop(BUCKET)), self.attrs)
        house.write_summaries(star)
        house.refresh(market.delivery(self.raw, self.attrs), raw, self.attrs)
        return house

    @property
    def star(self) -> dict[str, DataFrame]:
        return {
            "dim_etf": self.dim,
            "fact_prices": self.prices,
            "fact_rolling": self.rolling,
            "fact_anomalies": self.anomalies,
        }


def zones(spark: SparkSession, sf_dir: str) -> Zones:
    with _lock:
        at = (spark.sparkContext.applicationId, sf_dir)
        if at not in _zones:
            _zones[at] = Zones(spark, sf_dir)
        return _zones[at]
