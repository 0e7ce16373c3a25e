from __future__ import annotations

from pyspark.sql import functions as F

from panelstats.shared import numbered


def test_numbers_do_not_depend_on_how_a_scan_is_split(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(6000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).repartition(3).write.option("parquet.block.size", 20_000).parquet(path)
    found = []
    for size in ("8k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            docs = spark.read.parquet(path)
            parts = docs.rdd.getNumPartitions()
            found.append((parts, {r.id: r.n for r in numbered(docs, "n").select("id", "n").collect()}))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (many, first), (few, second) = found
    assert many > few and first == second and len(set(first.values())) == 6000


def test_frames_without_files_are_numbered_once(spark):
    rows = numbered(spark.range(50, numPartitions=4).withColumn("x", F.rand()), "n")
    assert {r.id: (r.x, r.n) for r in rows.collect()} == {r.id: (r.x, r.n) for r in rows.collect()}


def test_rows_that_multiply_have_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(200).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    twice = docs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    for frame, n in ((twice, 400), (docs.union(docs), 400), (docs.join(docs, "id"), 200), (docs.filter("id < 50").select("id"), 50)):
        rows = numbered(frame, "n").collect()
        assert len(rows) == n and len({r.n for r in rows}) == n
