"""Registered queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hamming, html, lm, mixing, negatives, packing, quality, repeats, search, simhash, substring, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Vocabulary file of the packing query; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from two thirds of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    train = toxicity.in_training(F.col("doc_id"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, train=train))
    return scored.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ARC archives to WARC archives and back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents, learnt from nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    train = lm.training_rows(F.col("doc_id"))
    scored = lm.score_documents(docs, train=train)
    first = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", (~lm.training_rows(F.col("doc_id"))).alias("held_out"), *first)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every twentieth vector among all vectors."""
    return hamming.nearest_vectors(table(spark, sf_dir, "embeddings"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that no source is repeated more than twice."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their long repeats of earlier ones."""
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted rules and the likelihood ratio's verdict on every document."""
    kept = quality.keep_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return kept.select(*first, "score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=negatives.contract_label())


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated 100-byte strings."""
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["begin"])
    runs = F.size("removed").cast("long")
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), runs.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_toxicity,
        op3_warc,
        op4_lm_scoring,
        op5_exact_topk,
        op6_simhash,
        op7_mixing,
        op8_best_fit_packing,
        op9_substring_dedup,
        op10_quality_rules,
        op11_hard_negatives,
        op12_suffix_dedup,
        op13_ranked_search,
    )
}

ORACLES: dict[str, str] = {
    "op5_exact_topk": hamming.nearest_sql(),
    "op7_mixing": mixing.mix_sql(),
    "op11_hard_negatives": negatives.negatives_sql(),
    "op12_suffix_dedup": repeats.repeats_sql(),
    "op13_ranked_search": search.search_sql(),
}
