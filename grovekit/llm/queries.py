"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_digest, gif_media, langid, mil_quality, mixing_tree, secret_battery, sentencepiece_scan, simhash_ring, token_transducer, url_filter
from .common import read_table, short_batches


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256, the digest of the text that the ids decode to."""
    short_batches(spark)
    found = sentencepiece_scan.encode(read_table(spark, sf_dir, "documents"), decoded=True)
    return found.select("doc_id", F.coalesce(F.expr("array_size(ids)"), F.lit(0)).cast("bigint").alias("n_tokens"), "ids", "decoded_sha256")


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return gif_media.stored_digests(read_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predicted(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return token_transducer.token_counts(read_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return secret_battery.scan(read_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.fit(pages))


def op7_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests beside the edited and next texts', and the class of equal canonical bytes: its first doc_id and size."""
    short_batches(spark)
    found = exact_digest.with_classes(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "first_doc_id", "copies")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    found = simhash_ring.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_ring.hex_of("fp").alias("fingerprint"), "component_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = read_table(spark, sf_dir, "documents")
    found = mil_quality.scored(docs, mil_quality.fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", mil_quality.held_out(F.col("doc_id")).alias("held_out"), "score", mil_quality.predicted().alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_tree.decisions(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
