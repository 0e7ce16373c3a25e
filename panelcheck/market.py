"""Daily bars and instrument attributes derived from the order tables.

One supplier is one instrument, one shipping day one bar.  The number of series therefore grows with
the tables while a series stays as long as the calendar.  All prices are whole cents until the last
step, so both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.spec import in_order, so_far

# Fixed values of the fixture, shared with the SQL text.
START_CENTS = 50_000
FIRST_RUN, SECOND_RUN = "2002-01-01", "2002-01-02"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker(suppkey: str):
    return F.concat(F.lit("SUP"), F.lpad(F.col(suppkey).cast("string"), 9, "0"))


def clean_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and shipping day: a random walk in cents.

    Only the daily sums cross the first exchange (combined on the map side), and the running level
    is taken over days, never over order lines, so a supplier with very many lines is no hot spot.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("sk"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_quantity").cast("long").alias("quantity"),
        (
            (F.round(F.col("l_discount") * 100).cast("long") - 5)
            * F.col("l_quantity").cast("long")
            * F.when(F.col("l_linenumber") == 7, 3).otherwise(1)
        ).alias("step"),
    )
    days = lines.groupBy("sk", "date").agg(
        F.sum("step").alias("move"),
        F.max("step").alias("best"),
        F.min("step").alias("worst"),
        F.sum("quantity").alias("volume"),
    )
    level = F.lit(START_CENTS) + F.sum("move").over(so_far("sk", "date"))
    walk = days.withColumn("close_c", level).withColumn("open_c", F.col("close_c") - F.col("move"))
    return walk.select(
        "sk",
        "date",
        "open_c",
        (F.greatest("open_c", "close_c") + F.greatest("best", F.lit(0))).alias("high_c"),
        (F.least("open_c", "close_c") + F.least("worst", F.lit(0))).alias("low_c"),
        "close_c",
        "volume",
        F.row_number().over(in_order("sk", "date")).alias("seq"),
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk as it would land: gaps, a missing start, corrected versions and plain copies.

    Versions are exploded from each bar rather than united from several branches, so the walk is
    computed once.
    """
    day = F.dayofyear("date")
    hole = (F.col("sk") * 7 + day) % 23 == 0
    lead = (F.col("seq") == 1) & (F.col("sk") % 4 == 0)
    quiet = (F.col("sk") * 5 + day) % 29 == 0
    versions = F.concat(
        F.array(F.lit(0)),
        F.when(day % 13 == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
        F.when(day % 11 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")),
    )
    bars = clean_walk(spark, sf_dir).withColumn("v", F.explode(versions))
    missing = (F.col("v") == 0) & (hole | lead)

    def price(c: str):
        return F.when(~missing, (F.col(c) + F.col("v") * 100).cast("double") / 100.0)

    volume = F.when(~(missing | ((F.col("v") == 0) & quiet)), F.col("volume") + F.col("v"))
    return bars.select(
        ticker("sk").alias("ticker"),
        F.concat(F.lit("Supplier#"), F.lpad(F.col("sk").cast("string"), 9, "0")).alias("etf_name"),
        "date",
        price("open_c").alias("open"),
        price("high_c").alias("high"),
        price("low_c").alias("low"),
        price("close_c").alias("close"),
        volume.alias("volume"),
        F.when(F.col("v") == 0, FIRST_RUN).otherwise(SECOND_RUN).alias("ingestion_date"),
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One instrument per supplier: provider is its nation, category its region."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select(
        ticker("s_suppkey").alias("ticker"),
        F.col("s_name").alias("etf_name"),
        F.col("n_name").alias("provider"),
        F.col("r_name").alias("category"),
        F.concat(F.lit("Index "), (F.col("n_nationkey") % 7).cast("string")).alias("index_tracked"),
        F.when(F.col("n_regionkey") == 3, "EUR").otherwise("USD").alias("currency"),
        F.when(F.col("n_nationkey") % 2 == 0, "LSE").otherwise("NYSE").alias("exchange"),
    )


def delivery(raw: DataFrame, attrs: DataFrame) -> DataFrame:
    """What one exchange delivers again: the bars of its instruments before 1999."""
    listed = attrs.filter(F.col("exchange") == "LSE").select("ticker")
    return raw.filter(F.col("date") < F.lit("1999-01-01").cast("date")).join(listed, "ticker", "left_semi")


def with_twins(prices: DataFrame) -> DataFrame:
    """Returns, with two followers of each instrument that move against it on some days."""
    own = prices.filter(F.col("daily_return").isNotNull()).select("ticker", "date", "daily_return")
    day = F.substring("ticker", 4, 20).cast("long") + F.dayofyear("date")
    found = own
    for prefix, every in (("TWIN", 25), ("SHADOW", 60)):
        moved = F.when(day % every == 0, -F.col("daily_return")).otherwise(F.col("daily_return"))
        found = found.union(own.select(F.concat(F.lit(prefix), "ticker"), "date", moved))
    return found


def tick_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bars of a few very long series: one per event type, one bar per instant."""
    i = F.col("event_id")
    versions = F.when(i % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    bars = table(spark, sf_dir, "events").withColumn("v", F.explode(versions))
    cents = F.round(F.col("value") * 100).cast("long") + 10_000 + F.col("v") * 100
    price = F.when((i % 23 != 0) | (F.col("v") == 1), cents.cast("double") / 100.0)
    return bars.select(
        F.col("event_type").alias("ticker"),
        F.concat(F.lit("Stream of "), "event_type").alias("etf_name"),
        F.col("ts").alias("date"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.when(i % 29 != 0, F.col("user_id")).alias("volume"),
        F.when(F.col("v") == 0, FIRST_RUN).otherwise(SECOND_RUN).alias("ingestion_date"),
    )
