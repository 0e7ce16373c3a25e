from __future__ import annotations

import random

import duckdb
import pytest

from panelstats.llm import hamming


def plain(rows, k, every=20):
    """(id, code) -> (query, rank, id, distance), nulls last."""
    out = []
    for q, code in rows:
        if q is not None and q % every == 0:
            near = sorted(((code ^ c).bit_count(), i is None, i or 0) for i, c in rows)[:k]
            out += [(q, n + 1, None if lost else i, d) for n, (d, lost, i) in enumerate(near)]
    return sorted(out, key=str)


def signed(code):
    return code - (1 << 64) if code >> 63 else code


def check(spark, rows, k):
    codes = spark.createDataFrame([(i, signed(c)) for i, c in rows], "id long, code long")
    got = hamming.nearest(codes, codes.filter("id % 20 = 0"), k).collect()
    assert sorted(((r.query_id, r.rank, r.id, r.distance) for r in got), key=str) == plain(rows, k)


def test_random_clustered_and_equal_codes(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, rng.getrandbits(64)) for i in range(120)]
    for i in range(120, 400):
        code = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, 9)):
            code ^= 1 << b
        rows.append((i, code))
    rows += [(i, centres[0]) for i in range(400, 520)] + [(None, centres[0]), (40, centres[1]), (40, centres[1])]
    check(spark, rows, 10)
    check(spark, rows, 3)


def test_fewer_rows_than_asked_for(spark):
    check(spark, [(0, 5), (20, (1 << 64) - 1), (3, 1 << 63)], 10)


def test_vectors_against_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    got = [tuple(r) for r in hamming.nearest_vectors(spark.read.parquet(path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}'")
    assert sorted(got) == sorted(con.execute(hamming.nearest_sql()).fetchall())


def test_odd_vectors(spark):
    rows = [(0, [1.0, -1.0], "x"), (20, None, "x"), (1, [], "x"), (2, [None, 2.0], "x"), (None, [0.0], "x"), (0, [1.0, -1.0], "x"), (5, [float("nan"), 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = hamming.nearest_vectors(df, k=3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got if r.query_id == 20) == [(20, 1, 1, 0), (20, 2, 20, 0), (20, 3, None, 0)]
    assert len(got) == 9
    assert hamming.nearest_vectors(df.limit(0)).collect() == []
    long = spark.createDataFrame([(0, [1.0] * 65)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        hamming.nearest_vectors(long).collect()
