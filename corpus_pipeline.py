"""From raw documents to packed training sequences, in five stages over operators of ``panelstats.llm``.

Each stage takes (spark, docs, sf_dir), where docs is a stored table, and returns a DataFrame: all but the last
with the columns of ``documents``.  No rows, null or empty texts, repeated rows, null ids and further columns
are handled as the operators define; every stage keeps further columns, except packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstats.llm import jaccard, mixing, packing, substring, toxicity
from panelstats.llm.queries import table, tokenizer_path
from panelstats.shared import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; learnt from the training part of the labels."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), train=toxicity.in_training(F.col("doc_id")))
    score = toxicity.score_udf(model, docs)
    return docs.filter(score(F.col("text")) < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class; texts link at a similarity of 0.8 on shingles of five words."""
    return jaccard.first_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without long repeats of earlier ones; n_chars is that of the text that is left."""
    cut = substring.deduplicate_rows(docs)
    n_chars = F.when(F.col("_llm_gone") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice."""
    return mixing.mixed_rows(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learnt scores and near-duplicate classes have no SQL; the tests run the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
