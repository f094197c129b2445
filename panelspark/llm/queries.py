"""The registered queries: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import (
    byte_bpe,
    conversations,
    decontaminate,
    fill_middle,
    hash_tree,
    jaccard_join,
    length_histogram,
    line_dedup,
    mixture,
    personal,
    quality,
    secrets,
    url_globs,
)
from panelspark.llm.common import table, written
from panelspark.llm.registry import query
from panelspark.llm import sql

#: Vocabulary of the token queries.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op1_spaced_seeds")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.mark_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op2_adaptive_quality", sql.QUALITY)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return quality.quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_url_globs", sql.URLS)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_globs.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"))


@query("op4_hash_tree", sql.SHARDS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"), 16)


@query("op5_secret_cnn")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text")))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query("op7_weak_supervision")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return personal.personal_digests(personal.find_personal(docs, personal.fit_spans(docs)))


@query("op8_line_hashes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_partition_jaccard")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join.link_components(docs, jaccard_join.JaccardRule(words=4, percent=85))


@query("op10_length_histogram")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counts = byte_bpe.token_counts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return length_histogram.context_totals(written(length_histogram.length_histogram(counts), "length-histogram"))


@query("op11_chunk_memo_fim", sql.FILL_MIDDLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_systematic_mix", sql.MIXTURE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixture.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op13_checkpoint_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digests(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
