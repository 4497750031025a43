"""The queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, jaccard, linededup, mixing, quality, secrets, tokencounts, tokenids, warc
from .common import fresh_path, table
from .oracles import ORACLES

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed tokenizer files are; the operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_findings(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("findings", lambda f: f["kind"] != "literal")
    return found.select(
        "doc_id", *(secrets.count_kind(F.col("findings"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("findings")).alias("spans"),
        secrets.count_kind(F.col("findings"), "literal").alias("n_literal"),
        F.size(F.filter("findings", lambda f: f["name"].isNotNull())).cast("long").alias("n_named"),
    )


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.token_ids(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition_quality(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontam.items_digest(F.col("items")).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), keep=["doc_id"])


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("_epoch").alias("epoch"), F.col("_block").alias("block"), F.col("_position").alias("position"), F.round("_weight", 9).alias("weight"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
