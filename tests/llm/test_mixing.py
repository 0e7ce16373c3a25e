from __future__ import annotations

import math
from collections import Counter, defaultdict

import duckdb
import pytest

from panelstats.llm import mixing


def sql_rows(df, sql):
    con = duckdb.connect()
    table = df.select("doc_id", "source", "text").toPandas()
    table["doc_id"] = table["doc_id"].astype("Int64")
    con.register("frame", table)
    con.execute("create table documents as select * from frame")
    return Counter((a, b, c, d, e) for a, b, c, d, e in con.execute(sql).fetchall())


def spark_rows(df):
    return Counter((r.doc_id, r.source, r.n_tokens, r.epoch, r.block) for r in df.collect())


def test_documents_against_sql(documents):
    for repeats in (1.5, 2.0, 4.0):
        got = spark_rows(mixing.mix(documents, mixing.Mix(repeats=repeats)))
        assert got == sql_rows(documents, mixing.mix_sql(repeats))


def test_odd_rows(odd_docs):
    assert spark_rows(mixing.mix(odd_docs)) == sql_rows(odd_docs, mixing.mix_sql())
    rows = mixing.mixed_rows(odd_docs)
    assert rows.columns == [*odd_docs.columns, "_llm_epoch", "_llm_block"]
    assert {r.row for r in rows.select("row").collect()} == set(range(12))
    assert mixing.mix(odd_docs.limit(0)).collect() == []


def test_one_source_is_taken_once(spark):
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(9)], "doc_id long, text string, source string")
    assert Counter(r.epoch for r in mixing.mix(docs).collect()) == {0: 9}


@pytest.fixture(scope="module")
def three(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), "big" if i % 10 < 7 else "mid" if i % 10 < 9 else "low") for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


def tokens_of(df):
    found = defaultdict(int)
    for r in df.collect():
        found[r.source] += r.n_tokens
    return found


def test_entropy_target_and_budget(three):
    own = Counter()
    for r in three.collect():
        own[r.source] += len(r.text.split()) + 1
    total = sum(own.values())
    entropy, budget = 0.95 * math.log(3), 40_000

    def weights(a):
        z = sum((t / total) ** a for t in own.values())
        return {s: (t / total) ** a / z for s, t in own.items()}

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        w = weights(mid)
        low, high = (low, mid) if -sum(x * math.log(x) for x in w.values()) <= entropy else (mid, high)
    want = weights(math.ceil(high * 1e6) / 1e6)
    got = tokens_of(mixing.mix(three, mixing.Mix(repeats=None, entropy=entropy, budget=budget)))
    for s, w in want.items():
        assert 0 <= got[s] - round(w * budget) <= 9


def test_repetition_limit_with_a_budget(three):
    got = tokens_of(mixing.mix(three, mixing.Mix(repeats=3.0, budget=20_000)))
    own = tokens_of(mixing.mix(three, mixing.Mix(repeats=1.0)))
    assert max(got[s] / own[s] for s in own) == pytest.approx(3.0, abs=0.02)


def test_blocks_have_the_target_weights(three):
    taken = mixing.mix(three, mixing.Mix(repeats=2.0)).collect()
    whole = Counter()
    half = Counter()
    for r in taken:
        whole[r.source] += r.n_tokens
        half[r.source] += r.n_tokens * (r.block < mixing.STREAM_BLOCKS // 2)
    assert all(abs(half[s] / whole[s] - 0.5) < 0.06 for s in whole)


def test_plan_runs_no_python(three):
    plan = mixing.mix(three)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
