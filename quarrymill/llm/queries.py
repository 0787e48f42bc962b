"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, contamination_sql, decontaminate, hard_negatives, html_text, packing, quality, simhash, suffix_dedup, tokens, url_filter, weighted_sampling
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = tokens.write_token_files(table(spark, sf_dir, "documents"))
    return tokens.read_token_files(folder, index).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, decontaminate.is_contaminated().alias("contaminated"))


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weighted_sampling
    return w.fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        w.as_text(F.col("sig")).alias("fingerprint"), w.as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        w.likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), w.likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.context_limits(tokens.length_histogram(table(spark, sf_dir, "documents")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.with_score(docs.select("doc_id", "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", quality.predicted().alias("predicted"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.RULES)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_token_files": op2_token_files,
    "op3_decontamination": op3_decontamination,
    "op4_harmonic_packing": op4_harmonic_packing,
    "op5_simhash": op5_simhash,
    "op6_weighted_sampling": op6_weighted_sampling,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_chat_perspectives": op8_chat_perspectives,
    "op9_token_counts": op9_token_counts,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_url_filter": op12_url_filter,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op3_decontamination": contamination_sql.CONTAMINATION_SQL, "op8_chat_perspectives": chat.ROTATE_SQL, "op11_collocations": collocations.COLLOCATIONS_SQL, "op12_url_filter": url_filter.URL_SQL, "op13_hard_negatives": hard_negatives.NEGATIVES_SQL}
