from __future__ import annotations

import subprocess
import sys
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from panelstats.llm import mixing, toxicity
from panelstats.llm.queries import ORACLES, QUERIES, tokenizer_path
from panelstats.shared import stored

from .test_jaccard import plain_firsts
from .test_mixing import sql_rows
from .test_packing import check_rows
from .test_substring import plain

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, documents):
    """Every stage's rows against plain Python over what its predecessor kept."""
    stages, docs = dict(corpus_pipeline.STAGES), documents
    assert list(stages) == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, stored(stage(spark, docs, SF_DIR), name)
        kept[name] = given.collect(), docs.collect()
        if name != "packing":
            assert docs.columns == documents.columns

    given, left = kept["toxicity"]
    model = toxicity.fit_toxicity(documents, spark.read.parquet(f"{SF_DIR}/labels.parquet"), train=toxicity.in_training(F.col("doc_id")))
    rejected = {r.doc_id for r in toxicity.score_toxicity(documents, model).collect() if r.predicted}
    assert sorted(left) == sorted(r for r in given if r.doc_id not in rejected)

    given, left = kept["simhash_near_dedup"]
    firsts = plain_firsts([(r.doc_id, r.text) for r in given])
    assert sorted(left) == sorted(r for r in given if r.doc_id in firsts)

    given, left = kept["substring_dedup"]
    want = plain([(r.doc_id, r.text) for r in sorted(given)])
    assert sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in left) == sorted(
        (r.doc_id, want[r.doc_id][0], r.lang, r.source, len(want[r.doc_id][0])) for r in given
    )

    given, left = kept["mixing"]
    frame = spark.createDataFrame(given, documents.schema)
    times = Counter()
    for (doc_id, *_), n in sql_rows(frame, mixing.mix_sql()).items():
        times[doc_id] += n
    assert Counter(r.doc_id for r in left) == times and {r.doc_id for r in left} == {r.doc_id for r in given}

    from tokenizers import Tokenizer

    given, left = kept["packing"]
    check_rows(left, Counter((r.doc_id, r.text) for r in given), Tokenizer.from_file(tokenizer_path()))


def test_run_is_the_stages_in_turn(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows and {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_on_odd_and_empty_tables(spark, odd_docs, written):
    for docs in (written(odd_docs, 2), written(odd_docs.limit(0), 1)):
        given = docs
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF_DIR), name)
            if name != "packing":
                assert docs.columns == odd_docs.columns
        assert docs.isEmpty() == given.isEmpty()


def test_planted_cases(spark, written):
    """Toxic documents go, one of each group of copies stays, clean documents are untouched."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("toxic = 1").collect()}
    docs = stored(corpus_pipeline.drop_toxic(spark, real, "/root/testdata/sf0.01"), "t")
    left = {r.doc_id for r in docs.collect()}
    assert len(left & toxic) < 0.4 * len(toxic)
    assert real.count() - len(left) < 2 * len(toxic) + 40

    text = " ".join(f"clean{i} text{i * 7}" for i in range(80))
    copies = [(i, text if i % 2 else text.upper(), "en", "s", len(text)) for i in range(2000, 2030)]
    with_copies = written(real.unionByName(spark.createDataFrame(copies, real.schema)))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, with_copies, SF_DIR).collect()}
    assert kept & set(range(2000, 2030)) == {2000}


def test_registry():
    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= names and set(ORACLES) <= set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("gone", ["panelstats.llm", "corpus_pipeline"])
def test_entry_without_the_subpackage(gone):
    code = f"""
import importlib.util as u, sys
find = u.find_spec
def without(name, *a):
    if name == {gone!r} or name.startswith({gone!r} + '.'):
        if '.' in name.removeprefix('panelstats.'):
            raise ModuleNotFoundError(name)
        return None
    return find(name, *a)
u.find_spec = without
import __spark_entry__ as e
names = set(e.queries())
assert 'pipeline' not in names and len(names) > 80 and set(e.oracle_sql()) <= names
assert any(n.startswith('op1_') for n in names) == ({gone!r} == 'corpus_pipeline')
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0])
