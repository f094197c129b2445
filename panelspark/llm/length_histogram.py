"""Token totals for every context limit from one exact length histogram.

Documents are counted by encoded length, which partial aggregation combines
before the shuffle. All answers come from suffix sums over the histogram: with
`at_least` documents of length >= L holding `tokens_at_least` tokens, cutting
every document at L leaves `total - tokens_at_least + L * at_least` tokens.

Suffix sums run over blocks of lengths and then over the blocks, so no task
holds the whole histogram. A null text has length 0 and is counted there. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of one block of suffix sums.
BLOCK = 1024


def length_histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """`n_tokens` and `n_docs`: documents by exact length; a null length counts as 0."""
    return counts.groupBy(F.coalesce(F.col(length), F.lit(0)).cast("bigint").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """One row per length that occurs, read as context limit L.

    n_docs, at_least and tokens_at_least (documents of at least L tokens),
    shorter (documents under L), truncated_total (tokens left when all documents
    are cut at L), lost_tokens (cut off by that), and per_mille (share of
    documents of at most L tokens, so that quantile q is the first row with
    per_mille >= 1000 q).
    """
    weighted = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("_t"),
                                F.floor(F.col("n_tokens") / BLOCK).alias("_block"))
    blocks = weighted.groupBy("_block").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    # blocks of blocks: the last level has one row per million lengths
    blocks = blocks.withColumn("_upper", F.floor(F.col("_block") / BLOCK))
    uppers = blocks.groupBy("_upper").agg(F.sum("_bd").alias("_ud"), F.sum("_bt").alias("_ut"))
    later = Window.orderBy(F.col("_upper").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    uppers = uppers.select("_upper", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in ("_ud", "_ut")],
                           F.sum("_ud").over(whole).alias("_docs"), F.sum("_ut").over(whole).alias("_tokens"))
    within = Window.partitionBy("_upper").orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_upper", "_block", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"{c}_after") for c in ("_bd", "_bt")])
    after = blocks.join(F.broadcast(uppers), "_upper").select(  # one row per million lengths
        "_block", "_docs", "_tokens", (F.col("_bd_after") + F.col("_ud_after")).alias("_d"),
        (F.col("_bt_after") + F.col("_ut_after")).alias("_t_after"))
    here = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc())
    sums = weighted.withColumn("_hd", F.sum("n_docs").over(here)).withColumn("_ht", F.sum("_t").over(here)).join(after, "_block")
    at_least, tokens = F.col("_hd") + F.col("_d"), F.col("_ht") + F.col("_t_after")
    truncated = F.col("_tokens") - tokens + F.col("n_tokens") * at_least
    upto = F.col("_docs") - at_least + F.col("n_docs")
    return sums.select(
        "n_tokens", "n_docs", at_least.alias("at_least"), tokens.alias("tokens_at_least"),
        (F.col("_docs") - at_least).alias("shorter"), truncated.alias("truncated_total"),
        (F.col("_tokens") - truncated).alias("lost_tokens"), F.floor(upto * 1000 / F.col("_docs")).alias("per_mille"))


def totals_at(totals: DataFrame, limits: Sequence[int]) -> DataFrame:
    """One row per listed context limit, whether or not a document has that length.

    `totals` is the result of `context_totals`. No suffix sum changes between two
    lengths that occur, so a limit takes those of the next greater length; beyond
    the longest document nothing is cut. Returns context_limit, at_least,
    tokens_at_least, truncated_total and lost_tokens; zeros for an empty table.
    The limits are a short list, answered in one aggregation over the lengths.
    """
    row = F.struct("n_tokens", "at_least", "tokens_at_least")
    found = totals.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("_total"), F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("context_limit"), F.min(F.when(F.col("n_tokens") >= n, row)).alias("next"))
        for n in limits]).alias("_rows"))
    each = found.select("_total", F.inline("_rows")).select(
        "_total", "context_limit", *[F.coalesce(F.col(f"next.{c}"), F.lit(0)).alias(c) for c in ("at_least", "tokens_at_least")])
    lost = F.col("tokens_at_least") - F.col("context_limit") * F.col("at_least")
    return each.select("context_limit", "at_least", "tokens_at_least", (F.col("_total") - lost).alias("truncated_total"),
                       lost.alias("lost_tokens"))


def length_quantiles(totals: DataFrame, shares: Sequence[float]) -> DataFrame:
    """`share` and `n_tokens`: the least length that at least this share of all documents does not exceed.

    `totals` is the result of `context_totals`; NULL lengths for an empty table.
    Shares are taken to the nearest millionth, so ranks are whole numbers.
    """
    docs = totals.agg(F.max("at_least").alias("_docs"))
    upto = (F.col("shorter") + F.col("n_docs")) * 1_000_000
    return totals.withColumn("_docs", docs.scalar()).agg(F.array(*[
        F.struct(F.lit(float(q)).alias("share"), F.min(F.when(upto >= F.col("_docs") * round(q * 1_000_000), F.col("n_tokens"))).alias("n_tokens"))
        for q in shares]).alias("_rows")).select(F.inline("_rows"))
