"""Exact nearest binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into segments, and each segment has an index from its value to the codes that
have it.  A query probes the segments at radius 0, then 1, and so on; what it finds is verified by the
full distance.  Once segments up to number a have been probed at radius r and the others at r - 1, every
code within ``segments * r + a`` bits has been found, for it differs by no more than that in some segment.
A query probes at a radius only as many segments as cover the kth distance it has, and ends as soon as
the kth distance is covered.

The codes of a segment's value are kept in lots of some hundred, so a probe that hits is a row, however
many codes it verifies, and no value's codes have to fit a task.  Equal codes are one entry with their ``k``
least ids, so a code that a third of all rows have costs one comparison.  Queries with equal codes are
searched once.

Defined results: ties go to the lesser id; a query is among its own neighbours; fewer than ``k`` rows give
all of them; a component that is null or missing is a 0 bit, and so is all of a null vector; rows with a
null id are neighbours (after all others), but no queries; repeated rows are rows of their own; empty tables
give empty results.  Vectors of more than 64 components raise an error.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.shared import stored

BITS = 64
#: Bits of a segment, within these bounds: the logarithm of the number of codes less this many.
LEAST_WIDTH, MOST_WIDTH, FEWER = 8, 16, 4
#: Codes of a lot, about.
LOT = 256
K = 10


def sign_code(vector: Column) -> Column:
    """Bit i is set where component i is positive."""
    powers = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)))
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.get(powers, i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    too_long = F.coalesce(F.size(vector), F.lit(0)) > BITS
    return F.when(too_long, F.raise_error(F.lit("codes have 64 bits")).cast("long")).otherwise(F.coalesce(code, F.lit(0).cast("long")))


def segments(n_codes: int) -> list[tuple[int, int]]:
    """First bit and width of each segment."""
    parts = round(BITS / min(MOST_WIDTH, max(LEAST_WIDTH, math.log2(max(n_codes, 2)) - FEWER)))
    cuts = [BITS * i // parts for i in range(parts + 1)]
    return list(zip(cuts[:-1], (b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))


def _segment(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _by_segment(df: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """A row a segment: seg, key."""
    each = F.array(*(F.struct(F.lit(i).alias("seg"), _segment(F.col("code"), a, w).alias("key")) for i, (a, w) in enumerate(cuts)))
    return df.withColumn("s", F.explode(each)).select(*df.columns, "s.seg", "s.key")


def build_index(distinct: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """seg, key, codes: lots of the codes (with least and copies) that have the value in the segment."""
    rows = _by_segment(distinct, cuts)
    sizes = rows.groupBy("seg", "key").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    dealt = rows.join(sizes, ["seg", "key"]).withColumn("lot", F.pmod(F.xxhash64("code"), F.col("lots")))
    return dealt.groupBy("seg", "key", "lot").agg(F.collect_list(F.struct("code", "least", "copies")).alias("codes")).drop("lot")


def _verified(hits: DataFrame, k: int) -> DataFrame:
    """Of each hit the ``k`` best codes that aren't farther than what the query has: query, distance, least, code, copies."""

    def measured(c: Column) -> Column:
        distance = F.bit_count(c["code"].bitwiseXOR(F.col("query"))).alias("distance")
        return F.struct(distance, c["least"].isNull().alias("lost"), c["least"].alias("least"), c["code"].alias("code"), c["copies"].alias("copies"))

    near = F.filter(F.transform("codes", measured), lambda c: F.col("far").isNull() | (c["distance"] <= F.col("far")))
    best = hits.select("query", F.explode(F.slice(F.array_sort(near), 1, k)).alias("c"))
    return best.select("query", "c.distance", "c.least", "c.code", "c.copies")


def nearest(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), id, distance: the ``k`` nearest rows of ``codes`` for each of ``queries``.

    Both have columns id and code.  Every round is written to the shared folder; its work is what the
    queries that aren't finished still have to probe.
    """
    spark = codes.sparkSession
    least = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    entries = stored(codes.select("id", "code").withColumn("nth", F.row_number().over(least)).filter(F.col("nth") <= k), "hamming-entries")
    distinct = stored(
        entries.groupBy("code").agg(F.min("id").alias("least"), F.count("*").cast("int").alias("copies")), "hamming-codes"
    )
    cuts = segments(distinct.count())
    index = stored(build_index(distinct, cuts), "hamming-index")
    wanted = min(k, entries.count())
    asked = stored(queries.filter(F.col("id").isNotNull()).select(F.col("id").alias("query_id"), "code"), "hamming-queries")
    active = asked.select(F.col("code").alias("query")).distinct().withColumn("far", F.lit(None).cast("int"))
    best = finished = None

    order = Window.partitionBy("query").orderBy("distance", F.col("least").asc_nulls_last(), "code")
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
    for radius in range(max(w for _, w in cuts) + 1 if wanted else 0):
        masks = spark.createDataFrame(
            [(i, sum(1 << b for b in some)) for i, (_, w) in enumerate(cuts) for some in combinations(range(w), radius)], "seg int, mask long"
        )
        needed = F.least(F.lit(len(cuts)), F.coalesce(F.col("far") - len(cuts) * radius + 1, F.lit(len(cuts))))
        active = active.withColumn("needed", needed)
        probes = _by_segment(active.withColumn("code", F.col("query")), cuts).filter(F.col("seg") < F.col("needed"))
        probes = probes.join(F.broadcast(masks), "seg").select("query", "far", "seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
        found = _verified(probes.join(index, ["seg", "key"]), k)
        if best is not None:
            found = found.unionByName(best.select(*found.columns))
        ranked = (
            found.distinct()
            .withColumn("nth", F.row_number().over(order))
            .filter(F.col("nth") <= k)
            .withColumn("before", F.coalesce(F.sum("copies").over(nearer), F.lit(0)))
            .filter(F.col("before") < wanted)
        )
        best = stored(ranked, "hamming-best")
        covered = len(cuts) * radius + F.col("needed") - 1
        reached = best.groupBy("query").agg(F.max("distance").alias("now"), F.sum("copies").alias("rows"))
        full = F.coalesce(F.col("rows"), F.lit(0)) >= wanted
        state = stored(
            active.join(reached, "query", "left").select("query", F.when(full, F.col("now")).alias("far"), (full & (F.col("now") <= covered)).alias("done")),
            "hamming-state",
        )
        over = best.join(state.filter("done").select("query"), "query", "left_semi")
        finished = over if finished is None else finished.unionByName(over)
        active = state.filter(~F.col("done")).select("query", "far")
        if active.isEmpty():
            break
        best = best.join(active.select("query"), "query", "left_semi")
    if finished is None:
        kinds = dict(codes.select("id").dtypes)["id"]
        return spark.createDataFrame([], f"query_id {kinds}, rank int, id {kinds}, distance int")
    rows = stored(finished, "hamming-found").select("query", "code", "distance").join(entries, "code").select("query", "distance", "id")
    place = Window.partitionBy("query").orderBy("distance", F.col("id").asc_nulls_last())
    top = rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return asked.join(top, F.col("code") == F.col("query")).select("query_id", "rank", "id", "distance")


def nearest_vectors(vectors: DataFrame, every: int = 20, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Neighbours of all vectors whose id is divisible by ``every`` among all vectors: query_id, rank, vec_id, distance."""
    codes = stored(vectors.select(F.col(id_col).alias("id"), sign_code(F.col(vector_col)).alias("code")), "hamming-rows")
    return nearest(codes, codes.filter(F.col("id") % every == 0), k).withColumnRenamed("id", "vec_id")


def nearest_sql(every: int = 20, k: int = K, table: str = "embeddings") -> str:
    """The same rows by comparing every query with every vector, for DuckDB."""
    bits = " + ".join(f"case when embedding[{i + 1}] > 0 then {1 << i}::hugeint else 0::hugeint end" for i in range(BITS))
    return f"""
with codes as (select vec_id, {bits} as code from {table}),
pairs as (
  select q.vec_id as query_id, c.vec_id, cast(bit_count(xor(q.code, c.code)) as integer) as distance
  from codes q, codes c where q.vec_id % {every} = 0
), ranked as (
  select *, row_number() over (partition by query_id order by distance, vec_id) as rank from pairs
)
select query_id, cast(rank as integer) as rank, vec_id, distance from ranked where rank <= {k}"""
