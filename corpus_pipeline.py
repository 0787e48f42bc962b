"""The corpus pipeline: each stage calls one operator of quarrymill.llm and works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate, packing, quality, simhash, suffix_dedup
from quarrymill.llm.common import NULL_ID, delete, delete_since, materialize, numbered_rows, own_id, table, written

ORACLE_SQL = None  # models, fingerprints and tokenizers are beyond SQL; tests hold it against brute force


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, rows of equal or null doc_id one by one; a null text is scored as an empty one."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs.select(*COLUMNS), model).where(quality.predicted() == 1).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 or more over five-word shingles, the one of the smallest id.

    A null id is the smallest; of rows of one id the one of the smaller text counts as the
    smaller. Null texts become empty, and of documents without words one stays.
    """
    firsts = simhash.similar_documents(docs).where("doc = first_doc and turn = first_turn").select("doc", "turn")
    rows = numbered_rows(docs, "lang", "source", "n_chars").join(firsts, ["doc", "turn"], "left_semi")
    return rows.select(own_id("doc").alias("doc_id"), "text", "lang", "source", "n_chars")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that occur earlier; a document of which nothing is left goes. Null texts become empty and stay."""
    kept = suffix_dedup.remove_repeats(docs, as_text=True).where("n_removed < n_bytes or n_bytes = 0")
    kept = kept.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "turn", F.col("kept").alias("text"))
    others = numbered_rows(docs, "lang", "source").drop("text")
    return kept.join(others, ["doc", "turn"]).select(own_id("doc").alias("doc_id"), "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold benchmark passages, rows of equal or null doc_id one by one; a null text has no words and stays."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return judged.where(~decontaminate.is_contaminated()).select("carried.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left: one row per piece. Every row, of a null text or a repeated id too, is a document with an end id."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between them the rows are written as Parquet and read again, and what a stage has written besides goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark, before = written(), docs
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        delete_since(spark, mark, keep=docs)
        if name != STAGES[0][0]:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
