"""Run queries against their SQL twins: ``python -m panelcheck.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from .queries import QUERIES
from .zones import zones


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A session on this machine; its zones go below the folder named here, unless one is given."""
    conf = {"spark.checkpoint.dir": "/tmp/checkpoints"} | conf
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelstats")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def rows_of(names: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, oracle: str) -> str | None:
    """What differs between a Spark result and the SQL's, or None."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(oracle)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (
        f"{sum(got.values())} rows instead of {sum(want.values())}; "
        f"{sum(extra.values())} extra such as {sorted(extra, key=str)[:2]}, "
        f"{sum(missing.values())} missing such as {sorted(missing, key=str)[:2]}"
    )


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark, con, failed = local_session(), duck(sf_dir), 0
    for name in argv[1:] or QUERIES:
        build, oracle = QUERIES[name]
        began = time.time()
        try:
            df = build(zones(spark, sf_dir))
            found = "no SQL" if oracle is None else difference(df, con, oracle)
        except Exception as e:  # report every query, whatever one of them raises
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += found not in (None, "no SQL")
        print(f"{'ok' if found is None else found:4} {name} {time.time() - began:.1f}s", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
