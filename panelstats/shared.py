"""The folder every executor reaches, and tables written there to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or where it is unset a folder beside the session's warehouse.

    On a cluster name one of them in the session: a warehouse that isn't configured either is a folder of the
    driver's machine, which executors don't share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
        if not warehouse:
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        root = f"{warehouse.rstrip('/')}/_shared"
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing was written to yet."""
    return f"{shared_folder(spark)}/panelstats/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written as a table in the shared folder and read from there.

    What is read later is what was written once, whichever executors are lost meanwhile.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files of a table whose ranks are sent to every task: 16 bytes each.
FILES = 1 << 20
#: Steps of a plan that neither multiply rows nor move them.
_PLAIN = {"LogicalRelation", "Project", "Filter", "SubqueryAlias", "View"}


def _is_scan(df: DataFrame) -> bool:
    """Whether a frame's rows are rows of files, each of one."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        step = todo.pop()
        if step.nodeName() not in _PLAIN:
            return False
        todo += [step.children().apply(i) for i in range(step.children().size())]
    return True


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows of a stored table with a number of their own in column ``name``, the same in every scan.

    The number has the rank of the row's file by its path, and the row's place in the file: how a scan is split
    among executors doesn't matter.  Ranks meet rows by a hash of the path.  Frames that are more than a scan are written
    once with their numbers.
    """
    path, place = f"{name}_path", f"{name}_place"
    if not _is_scan(docs):
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # files of a kind that doesn't number its rows
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    rank = F.row_number().over(Window.orderBy(path)).cast("long")
    hashed = F.xxhash64(path).alias(path)
    files = [tuple(r) for r in rows.select(path).distinct().select(hashed, rank.alias(name)).collect()]  # as the driver lists them
    if len({h for h, _ in files}) < len(files):  # two paths with one hash
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    ranks = docs.sparkSession.createDataFrame(files, f"`{path}` long, `{name}` long")
    ranks = F.broadcast(ranks) if len(files) <= FILES else ranks
    return rows.withColumn(path, hashed).join(ranks, path).select(*docs.columns, (F.shiftleft(name, 40) + F.col(place)).alias(name))
