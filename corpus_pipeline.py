"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage works on all that the one before it kept. A document that the quality
rules reject goes; of each group of near duplicates the document with the least
id stays; documents that leak benchmark items go; personal data is replaced in
the text; the rest is encoded, and decoded to prove it.

Null texts have no words and go in the first stage. Documents without an id are
no near duplicates of any and pass the second stage. Empty tables stay empty,
and columns beyond those of `documents` pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, decontaminate, jaccard_join, personal, quality
from panelspark.llm.common import small, table, written
from panelspark.llm.queries import VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.keep_good(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those with a near duplicate of a lower id (five words, similarity 0.8)."""
    linked = jaccard_join.link_components(docs)
    extra = linked.where("component_id != doc_id").select(F.col("doc_id").alias("_extra")).distinct()
    extra = small(written(extra, "near-duplicates"))
    return docs.join(extra, docs["doc_id"] == extra["_extra"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no item of `benchmark`."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return personal.redact_personal(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the bytes they decode to."""
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact),
    ("byte-level BPE", encode),
]

#: Spans and tokens are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents", "*")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
