"""Sharding by a weighted hash tree: region, rack, shard.

A row descends the tree. At each level every child draws `-ln(u) / weight` with
`u` hashed from the row's id and the child's name, and the least draw wins. A
child therefore receives its share of the weight, and a weight that changes
moves rows into or out of its own subtree only.

A tree for n shards has the base shards in regions of racks; each further shard
opens a region of its own, so one more shard takes rows only into itself. The
law is `key`: id and shard count alone decide.

A null id counts as the empty text, a null text has size 1 and the CRC of an
empty text. Repeated rows get the same shard and slots of their own. An empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import uniform

#: Rows of a shard that one slot block holds on average.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class Leaf:
    shard: int
    region: str
    rack: str
    weight: float = 1.0


def shard_tree(shards: int, base: int = 16, racks: int = 4, per_rack: int = 4, regions: int = 2) -> list[Leaf]:
    """`base` shards in `regions` of racks; every further shard has a region and rack of its own."""
    leaves = []
    for s in range(shards):
        rack = s // per_rack
        name = f"g{rack * regions // racks}" if s < base else f"g+{s}"
        leaves.append(Leaf(s, name, f"{name}/k{rack}" if s < base else f"{name}/k0"))
    return leaves


def _draw(row_id: Column, name: str, weight: float) -> Column:
    return -F.ln(uniform(row_id, name)) / F.lit(float(weight))


def _winner(row_id: Column, children: list[tuple[str, float]]) -> Column:
    """Index of the child with the least draw; the earlier one at a tie."""
    if len(children) == 1:
        return F.lit(0)
    draws = [F.struct(_draw(row_id, name, weight).alias("d"), F.lit(i).alias("i")) for i, (name, weight) in enumerate(children)]
    return F.least(*draws)["i"]


def tree_shard(row_id: Column, leaves: list[Leaf]) -> Column:
    """The shard of a row: one weighted draw per level."""

    def descend(part: list[Leaf], levels: list) -> Column:
        if not levels:
            return F.lit(part[0].shard)
        groups: dict[str, list[Leaf]] = {}
        for leaf in part:
            groups.setdefault(levels[0](leaf), []).append(leaf)
        ways = [descend(group, levels[1:]) for group in groups.values()]
        if len(ways) == 1:
            return ways[0]
        chosen = _winner(row_id, [(name, sum(leaf.weight for leaf in group)) for name, group in groups.items()])
        return reduce(lambda rest, i: F.when(chosen == i, ways[i]).otherwise(rest), range(len(ways) - 1), ways[-1])

    return descend(leaves, [lambda x: x.region, lambda x: x.rack, lambda x: f"s{x.shard}"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and grown_shard (the shard if there were one more).

    Slots follow the hash of key, size and CRC. Blocks are leading digits of that
    hash, so neither their number nor the partitioning changes a slot, and a
    shard is never ordered in one task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(key).alias(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32")
    )
    placed = base.select(
        "*", tree_shard(F.col(key), shard_tree(shards)).alias("shard"),
        tree_shard(F.col(key), shard_tree(shards + 1)).alias("grown_shard"),
        F.md5(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), "size", "text_crc32")).alias("_rank"),
    )
    digits, blocks = 2, shards * 256
    rows = docs.count()
    while blocks * SLOT_ROWS < rows:
        digits, blocks = digits + 1, blocks * 16
    placed = placed.withColumn("_block", F.substring("_rank", 1, digits))
    counts = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    # leading digits split the block table itself, so that its running sums are no single task either
    head = F.substring("_block", 1, 2)
    heads = counts.groupBy("shard", head.alias("_head")).agg(F.sum("_n").alias("_hn"))
    head_from = heads.select("shard", "_head", (F.sum("_hn").over(Window.partitionBy("shard").orderBy("_head")) - F.col("_hn")).alias("_hfrom"))
    within = Window.partitionBy("shard", "_head").orderBy("_block")
    starts = (
        counts.withColumn("_head", head).withColumn("_wfrom", F.sum("_n").over(within) - F.col("_n"))
        .join(F.broadcast(head_from), ["shard", "_head"])  # at most 256 rows per shard
        .select("shard", "_block", (F.col("_hfrom") + F.col("_wfrom")).alias("_from"))
    )
    order = Window.partitionBy("shard", "_block").orderBy("_rank", F.col(key).asc_nulls_first())
    return (
        placed.withColumn("_row", F.row_number().over(order))
        .join(starts, ["shard", "_block"])
        .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("_from") + F.col("_row") - 1).cast("long").alias("slot"), "grown_shard")
    )
