"""Registered queries: each applies one operator to its whole table and
returns its full result with the digest columns that checks compare."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe, cover_tree, decontaminate, filter_audit, langid, line_dedup, merkle, ngram_join, quality, secrets, sharding,
    substring_dedup, token_stream,
)
from .common import shared_path, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.embedding_links(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_language_model(docs.where(~langid.held_out()))
    return langid.predict_language(docs, model).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected"
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~langid.held_out()
    )
    return scored.select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.line_dedup(table(spark, sf_dir, "documents"), keep_copies=False, max_edits=2)
    return cut.select(
        "doc_id", "n_lines", "n_repeats", "n_removed", "is_copy",
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_stream.write_tokens(
        table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
        added_tokens=True,
    )
    return token_stream.read_tokens(spark, path)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), digest=True)
    return cut.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"), merkle.lower_some())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_embedding_links": op2_embedding_links,
    "op3_language_id": op3_language_id,
    "op4_quality": op4_quality,
    "op5_decontaminate": op5_decontaminate,
    "op6_line_dedup": op6_line_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_stream": op8_token_stream,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_bpe": op10_bpe,
    "op11_sharding": op11_sharding,
    "op12_filter_audit": op12_filter_audit,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": filter_audit.AUDIT_SQL,
}
