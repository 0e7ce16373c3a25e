"""The schema stored with a zone, so that reading it opens no footers.

It is a file beside the data.  A zone's schema grows with what arrives: new columns are added, and a column of
numbers may become wider, in which case older files are read as the wider type.  Any other change of a type is
refused.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Begin of the names of the files that state a schema; the newest one counts.
SCHEMA = "_schema-"
#: Types that files of a narrower type can be read as.
_WIDER: dict[type[T.DataType], tuple[type[T.DataType], ...]] = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType),
    T.ShortType: (T.IntegerType, T.LongType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
}


def place(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _versions(spark: SparkSession, path: str) -> list:
    files, pattern = place(spark, f"{path}/{SCHEMA}*")
    return sorted(files.globStatus(pattern) or [], key=lambda f: f.getPath().getName())


def stored_schema(spark: SparkSession, path: str) -> T.StructType | None:
    """The schema stored with a zone, if there is one."""
    versions = _versions(spark, path)
    if not versions:
        return None
    files, at = versions[-1].getPath().getFileSystem(spark._jsc.hadoopConfiguration()), versions[-1].getPath()
    stream = files.open(at)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return T.StructType.fromJson(json.loads(text))


def store_schema(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """State a zone's schema.  A file is written under another name and renamed, so no reader sees half of it."""
    versions = _versions(spark, path)
    number = int(versions[-1].getPath().getName().removeprefix(SCHEMA)) + 1 if versions else 0
    files, draft = place(spark, f"{path}/_draft-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(schema.json().encode()))
    finally:
        stream.close()
    if not files.rename(draft, place(spark, f"{path}/{SCHEMA}{number:08d}")[1]):
        raise RuntimeError(f"another writer states the schema of {path}")


def wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The one of two types that holds both, if there is one."""
    if a == b:
        return a
    return b if type(b) in _WIDER.get(type(a), ()) else a if type(a) in _WIDER.get(type(b), ()) else None


def widened(known: T.StructType | None, arriving: T.StructType) -> T.StructType:
    """The schema that holds stored and arriving columns, or an error."""
    if known is None:
        return T.StructType([T.StructField(f.name, f.dataType) for f in arriving.fields])
    fields = {f.name: f.dataType for f in known.fields}
    differ = []
    for f in arriving.fields:
        now = wider(fields.get(f.name, f.dataType), f.dataType)
        if now is None:
            differ.append(f.name)
        fields[f.name] = now
    if differ:
        raise ValueError(f"stored columns have other types: {', '.join(differ)}")
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with exactly the columns of a schema: missing ones NULL, narrower ones cast."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
