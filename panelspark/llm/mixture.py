"""Mixing sources to target weights by systematic sampling.

Sources share a budget of words by weight; a target stops at `most` times its
source's size and the excess is shared again. A document is expected to occur
target / source size times. Within its source, documents stand in order of size
class and hash; their expected copies are summed up along that order, one random
offset per source is added, and a document is emitted once for every whole
number that its stretch of the sum crosses. As neighbours are of like size, the
words taken stay within about one document of the target. All sums are exact
integers, so no rounding ever adds or loses a copy.

A null text has no words; a null source is the last source. A source without
words has target 0. Documents without words take part in the order and take no
words. Repeated rows are counted before they are ordered and get places of their
own, so that a row repeated without end is no sorting work. An empty table gives
an empty result; other columns of the input are ignored. Texts are counted whole,
whatever their length. Places come from blocks (source, size class, leading hash
digits), so no source is sorted in one task; only tables with one row per source
are ordered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import small, written

#: Rows of a block that are ordered together on average.
BLOCK_ROWS = 20_000
#: Steps of the random offset between two whole numbers.
OFFSETS = 2**20


@dataclass(frozen=True)
class MixRule:
    weights: tuple[int, ...] = (3, 1, 2)
    percent: int = 150
    most: int = 2
    seed: int = 42


def _big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def source_targets(sources: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """`_key`, source_size, target, and expected copies of a document as `_num` / `_den`; one row per source in and out.

    Sources that reach their limit are the first ones in order of size over
    weight, so two running sums find them without any iteration.
    """
    place = Window.orderBy("_key")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, rule.weights)), ((F.row_number().over(place) - 1) % len(rule.weights) + 1).cast("int"))
    common = 1
    for w in rule.weights:
        common *= w
    rows = sources.select("_key", _big("source_size").alias("_size"), _big(weight).alias("_w")).withColumns({
        "_total": F.sum("_size").over(whole), "_level": F.expr(f"_size * {common} / _w")})
    before = Window.orderBy("_level", "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "_full_before": F.coalesce(_big(F.sum("_size").over(before)), F.lit(0)),
        "_open_from": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))})
    full = (F.lit(100 * rule.most) * _big("_size") * _big("_open_from")
            < _big("_w") * (F.lit(rule.percent) * _big("_total") - F.lit(100 * rule.most) * _big("_full_before")))
    rows = rows.withColumn("_full", full).withColumns({
        "_sated": F.coalesce(F.sum(F.when(F.col("_full"), F.col("_size"))).over(whole), F.lit(0)),
        "_open": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))).over(whole), F.lit(0))})
    share = _big("_w") * (F.lit(rule.percent) * _big("_total") - F.lit(100 * rule.most) * _big("_sated"))
    num = F.when(F.col("_full"), F.lit(100 * rule.most) * _big("_size")).otherwise(share)
    den = F.when(F.col("_full"), F.lit(100).cast("decimal(38,0)")).otherwise(F.lit(100) * _big("_open"))
    rows = rows.withColumns({"_num": _big(num), "_part": _big(den)})
    return rows.select("_key", F.col("_size").cast("long").alias("source_size"),
                       (F.col("_num").cast("double") / F.col("_part").cast("double")).alias("target"),
                       "_num", _big(F.col("_part") * F.col("_size")).alias("_den"))


def _size_class(size):
    """Sizes below 16 by themselves, larger ones in 16 steps per doubling."""
    bits = F.length(F.bin(size))
    return F.when(size < 16, size).otherwise(
        (bits - 4) * 16 + F.expr(f"shiftright(size, cast(length(bin(size)) - 5 as int))") - 16).cast("int")


def mix_sources(docs: DataFrame, rule: MixRule = MixRule(), key: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """Per row: key, size, source_size, target, copies and taken (size times copies)."""
    sized = docs.select(
        F.col(key).alias("_doc"), F.when(F.col(source).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source))).alias("_key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    sized = written(sized.groupBy("_key", "_doc", "size").agg(F.count(F.lit(1)).alias("_n")), "mix-sizes").select(
        "*", _size_class(F.col("size")).alias("_class"),
        F.md5(F.concat_ws("|", F.lit(str(rule.seed)), F.coalesce(F.col("_doc").cast("string"), F.lit("")), "size")).alias("_rank"))
    classes = written(sized.groupBy("_key", "_class").agg(
        F.sum("_n").alias("_cn"), F.sum(F.col("size") * F.col("_n")).alias("_words"), F.count(F.lit(1)).alias("_rows")), "mix-classes")
    targets = source_targets(classes.groupBy("_key").agg(F.sum("_words").alias("source_size")), rule)
    digits, peak = 0, classes.agg(F.max("_rows")).first()[0] or 0
    while BLOCK_ROWS * 16**digits < peak:
        digits += 1
    block = F.substring("_rank", 1, digits)
    counts = sized.groupBy("_key", "_class", block.alias("_block")).agg(F.sum("_n").alias("_bn"))
    class_from = classes.select("_key", "_class", (F.sum("_cn").over(
        Window.partitionBy("_key").orderBy("_class")) - F.col("_cn")).alias("_class_from"))
    starts = counts.select("_key", "_class", "_block", (F.sum("_bn").over(
        Window.partitionBy("_key", "_class").orderBy("_block")) - F.col("_bn")).alias("_block_from"))
    bounds = starts.join(class_from, ["_key", "_class"]).join(targets, "_key").withColumn("_from", F.col("_class_from") + F.col("_block_from"))
    bounds = small(written(bounds.drop("_class_from", "_block_from"), "mix-blocks"))
    within = Window.partitionBy("_key", "_class", "_block").orderBy("_rank", F.col("_doc").asc_nulls_first(), "size")
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(rule.seed)), "_key")), 1, 5), 16, 10)
    placed = (
        sized.withColumn("_block", block)
        .withColumn("_ahead", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .join(bounds, ["_key", "_class", "_block"])
        .withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("_at", _big(F.col("_from") + F.col("_ahead") + F.col("_i"))).withColumn("_offset", _big(offset)))

    def crossed(at: str) -> str:
        return f"(({at}) * _num * {OFFSETS} + _offset * _den) div (_den * {OFFSETS})"

    copies = F.when(F.col("_den") == 0, F.lit(0)).otherwise(F.expr(f"{crossed('_at + 1')} - {crossed('_at')}")).cast("long")
    return placed.withColumn("copies", copies).select(
        F.col("_doc").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
