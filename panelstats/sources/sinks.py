"""Writing zones, exporting results, registering views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import exchange_partitions
from ..shared import stored
from ..spec import PanelSpec
from .schema import place, shaped, store_schema, stored_schema, widened

BUCKET = "key_bucket"
#: Begin of the name of the empty file that states a bucket count.
COUNT = "_buckets-"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key: the one Spark's own bucketed tables put it into."""
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def write_fact(
    df: DataFrame,
    path: str,
    spec: PanelSpec = PanelSpec(),
    layout: str = "key",
    table: str | None = None,
    buckets: int | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Overwrite a fact and return it as read back.

    ``layout="key"`` writes one directory per key: right for a moderate number of keys.  The rows
    are rebalanced by key first, so a small key is one file and a huge one is split over several
    tasks.

    ``layout="bucket"`` hashes the keys into ``buckets`` and registers the external table ``table``:
    right for any number of keys.  Windows, groupings and joins on the key then need no exchange.
    ``clustered=True`` states that the plan already ends partitioned by key into as many partitions
    as there are buckets (any key window does), which saves the exchange before the write.

    ``layout="hashed"`` is the same with a directory for each bucket, so that ``replace_buckets`` can rewrite
    some of them; the table has the bucket as its last column.
    """
    spark = df.sparkSession
    if layout == "key":
        placed = df.hint("rebalance", spec.key).sortWithinPartitions(spec.key, spec.ts)
        placed.write.mode("overwrite").partitionBy(spec.key).parquet(path)
        store_schema(spark, path, df.schema)
        return spark.read.schema(df.schema).option("basePath", path).parquet(path)
    if layout not in ("bucket", "hashed"):
        raise ValueError(f"unknown layout {layout!r}")
    if table is None:
        raise ValueError("a bucketed fact needs a table name")
    return _write_bucketed(df, path, table, spec.key, [spec.key, spec.ts], buckets, clustered, layout == "hashed")


def write_dim(
    df: DataFrame,
    path: str,
    key: str | None = None,
    table: str | None = None,
    buckets: int | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Overwrite a dimension without partition directories.

    With ``table`` it is bucketed by ``key`` like the facts, so that a dimension too large to
    broadcast still joins them without an exchange; ``hashed`` gives each bucket a directory.
    """
    if table is not None:
        return _write_bucketed(df, path, table, key, [key], buckets, clustered=False, hashed=hashed)
    df.write.mode("overwrite").parquet(path)
    store_schema(df.sparkSession, path, df.schema)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header per task; nothing is funnelled into a single file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def replace_keys(
    df: DataFrame, path: str, spec: PanelSpec = PanelSpec(), buckets: int | None = None
) -> list[int]:
    """Replace the whole history of every arriving key; other keys keep their data.

    Without ``buckets`` each key is a directory and only the arriving directories are overwritten.
    With ``buckets`` keys share hashed directories: those that receive a key, and only those, are read
    and rewritten with their other keys carried over; returns their numbers.  The first call stores the count with
    the zone, and another count is refused.  The zone's schema is stored with it: columns that only one side has
    are kept, NULL on the other, numbers may become wider, and another change of a type is refused.  The arrivals
    are evaluated once: those of a first call go straight to the zone, later ones are stored.
    """
    spark = df.sparkSession
    schema, touched, first = widened(_zone_schema(spark, path), df.schema), [], False
    if buckets is None:
        out, by = shaped(df, schema), spec.key
    else:
        by = BUCKET
        claim_buckets(spark, path, buckets)
        arrivals = shaped(df, schema).withColumn(BUCKET, bucket_of(spec.key, buckets))
        first = not bucket_folders(spark, path)
        arrivals = arrivals if first else stored(arrivals, "arrivals")
        touched = [] if first else sorted(r[0] for r in arrivals.select(BUCKET).distinct().collect())  # at most ``buckets``
        out, folders = arrivals, [f for b in touched if exists(spark, f := f"{path}/{BUCKET}={b}")]
        if folders:
            before = spark.read.schema(arrivals.schema).option("basePath", path).parquet(*folders)
            keys = arrivals.select(F.col(spec.key).alias("_arriving")).distinct()
            kept = before.join(keys, F.col(spec.key).eqNullSafe(F.col("_arriving")), "left_anti")
            out = arrivals.unionByName(kept)
    if schema != stored_schema(spark, path):
        store_schema(spark, path, schema)
    (
        out.hint("rebalance", by)
        .sortWithinPartitions(by, spec.key, spec.ts)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(by)
        .parquet(path)
    )
    return bucket_folders(spark, path) if first else touched


def bucket_folders(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the buckets that a zone has a directory of."""
    files, at = place(spark, f"{path}/{BUCKET}=*")
    return sorted(int(f.getPath().getName().removeprefix(f"{BUCKET}=")) for f in files.globStatus(at) or [])


def _zone_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The stored schema of a zone; that of its footers where a zone was written without one."""
    known = stored_schema(spark, path)
    files, written = place(spark, f"{path}/*=*/*.parquet")
    if known is None and len(files.globStatus(written) or []):
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        known = T.StructType([f for f in found.fields if f.name != BUCKET])
    return known


def replace_buckets(df: DataFrame, path: str, table: str, key: str, buckets: int, touched: list[int]) -> None:
    """Rewrite some buckets of a hashed table; those of them that ``df`` has no row of become empty.

    ``df`` has the table's columns but the bucket.  Other directories are neither read nor written.
    """
    spark = df.sparkSession
    columns = spark.table(table).columns
    placed = df.repartition(buckets, key).withColumn(BUCKET, bucket_of(key, buckets)).select(*columns)
    before = bucket_files(spark, path, touched)
    mode = "spark.sql.sources.partitionOverwriteMode"
    own = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        placed.write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, own)
    drop_left_over(spark, path, before)
    spark.catalog.refreshTable(table)


def bucket_files(spark: SparkSession, path: str, buckets: list[int]) -> dict[int, set[str]]:
    """Names of the files in some directories of buckets."""
    found: dict[int, set[str]] = {b: set() for b in buckets}
    files, at = place(spark, f"{path}/{BUCKET}=*/*")
    for f in files.globStatus(at) or []:
        b = int(f.getPath().getParent().getName().removeprefix(f"{BUCKET}="))
        if b in found:
            found[b].add(f.getPath().getName())
    return found


def drop_left_over(spark: SparkSession, path: str, before: dict[int, set[str]]) -> None:
    """Remove files that were there before a write of their buckets and still are: the bucket has no rows any more."""
    for b, now in bucket_files(spark, path, list(before)).items():
        for name in before[b] & now:
            files, at = place(spark, f"{path}/{BUCKET}={b}/{name}")
            files.delete(at, False)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def _write_bucketed(
    df: DataFrame,
    path: str,
    table: str,
    key: str,
    order: list[str],
    buckets: int | None,
    clustered: bool,
    hashed: bool = False,
) -> DataFrame:
    spark = df.sparkSession
    n = buckets or exchange_partitions(spark)
    placed = df if clustered else df.repartition(n, key)
    writer = placed.withColumn(BUCKET, bucket_of(key, n)).write.partitionBy(BUCKET) if hashed else placed.write
    writer.mode("overwrite").option("path", path).bucketBy(n, key).sortBy(*order).saveAsTable(table)
    store_schema(spark, path, spark.table(table).schema)
    return spark.table(table)


def register_bucketed(
    spark: SparkSession, path: str, table: str, key: str, order: list[str], buckets: int, hashed: bool = False
) -> DataFrame:
    """A stored bucketed zone as a table of this session's catalog, if it isn't one yet."""
    schema = stored_schema(spark, path) or spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{c}`" for c in order)
    parts = f"partitioned by (`{BUCKET}`) " if hashed else ""
    known = spark.catalog.tableExists(table)
    spark.sql(
        f"create table if not exists {table} ({columns}) using parquet {parts}"
        f"clustered by (`{key}`) sorted by ({by}) into {buckets} buckets location '{path}'"
    )
    if hashed and not known:
        spark.sql(f"alter table {table} recover partitions")
    return spark.table(table)


def exists(spark: SparkSession, path: str) -> bool:
    files, at = place(spark, path)
    return files.exists(at)


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """The bucket count stored with a zone or warehouse, if there is one."""
    files, at = place(spark, f"{path}/{COUNT}*")
    found = files.globStatus(at) or []
    return int(found[0].getPath().getName().removeprefix(COUNT)) if len(found) else None


def claim_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    """Store the bucket count with a zone, or refuse another one than is stored."""
    known = stored_buckets(spark, path)
    if known is None:
        files, at = place(spark, f"{path}/{COUNT}{buckets}")
        files.createNewFile(at)
    elif known != buckets:
        raise ValueError(f"{path} has {known} buckets, not {buckets}")

