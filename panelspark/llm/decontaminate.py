"""Benchmark decontamination by spaced seeds.

Texts are words of letters and digits, lower-cased. A mask names the positions
of a window that count; the others may differ. The masked windows of all
benchmark items and of all documents are hashed and joined. Around each hit the
item is laid along the document without gaps, and the best stretch (+1 for an
equal word, -2 for another) is the overlap. A document leaks an item if the
overlap has at least `least` equal words, or `percent` of the words of a shorter
item.

All masks begin with the same two words, so windows whose two first words open
no window of the benchmark are skipped before they are masked. Only the first of
neighbouring hits passes the join: a hit whose window one
word earlier is a hit of the same mask adds nothing. Benchmark seeds are
broadcast in blocks of bounded size, one pass over the documents per block, so
neither side is shuffled by its hashes and no word or passage makes a hot key.

Equal items count once, under their least id. Items with fewer words than the
longest mask have no seeds and match nothing; so have null and empty texts.
Repeated rows give the same result each; rows with a null id share one result.
Empty tables give empty results, or clean documents where only the benchmark is
empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import small, written

#: Seeds of the benchmark that are broadcast at once (about 40 bytes each).
BLOCK_SEEDS = 200_000


@dataclass(frozen=True)
class SeedRule:
    masks: tuple[tuple[int, ...], ...] = ((0, 1, 3, 4, 5, 6), (0, 1, 3, 5, 6, 9), (0, 1, 2, 4, 8, 9))  # all begin with 0, 1
    least: int = 13
    percent: int = 80
    miss: int = 2

    @property
    def span(self) -> int:
        return 1 + max(map(max, self.masks))


def word_hashes(text: Column) -> Column:
    """Hashes of the words in order; empty for a null text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    """Hash of a masked window; null if it leaves the text on the left."""
    value = F.xxhash64(F.lit(number), *[F.get(hashes, at + o) for o in mask])
    return F.when(at >= 0, value)


def starts(rows: DataFrame, rule: SeedRule, *keep: str) -> DataFrame:
    """The `keep` columns, `words`, `at` and `anchor` (hash of the words every mask begins with) of every window."""
    placed = rows.select(*keep, "words", F.posexplode("words").alias("at", "word"))
    return placed.select(*keep, "words", "at", F.xxhash64("word", F.get("words", F.col("at") + 1)).alias("anchor"))


def windows(placed: DataFrame, rule: SeedRule, *keep: str) -> DataFrame:
    """`seed` and `before` (the seed one word earlier) of every masked window that begins at `at`."""
    seeds = F.array(*[
        F.struct(_seed(F.col("words"), F.col("at"), i, m).alias("seed"), _seed(F.col("words"), F.col("at") - 1, i, m).alias("before"))
        for i, m in enumerate(rule.masks)])
    fits = F.col("at") + rule.span <= F.size("words")
    return placed.where(fits).select(*keep, "words", "at", F.inline(seeds))


def overlap(words: Column, item: Column, skipped: Column, miss: int) -> Column:
    """Equal words of the best stretch when the item, less its `skipped` first words, is laid along `words`."""
    start = F.struct(F.lit(0).alias("score"), F.lit(0).alias("equal"), F.lit(0).alias("best"), F.lit(0).alias("found"))

    def step(acc: Column, j: Column) -> Column:
        same = F.get(words, j) == F.get(item, j + skipped)
        score = acc["score"] + F.when(same, 1).otherwise(-miss)
        equal = F.when(score > 0, acc["equal"] + same.cast("int")).otherwise(0)
        better = score > acc["best"]
        return F.struct(F.greatest(score, F.lit(0)).alias("score"), equal.alias("equal"),
                        F.greatest(acc["best"], score).alias("best"), F.when(better, equal).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, step, lambda acc: acc["found"])


def benchmark_items(benchmark: DataFrame, rule: SeedRule, item: str = "item_id", text: str = "text") -> DataFrame:
    """`item` and `item_words` of the distinct items long enough for the masks."""
    items = benchmark.select(F.col(item).alias("item"), word_hashes(F.col(text)).alias("item_words"))
    return items.where(F.size("item_words") >= rule.span).groupBy("item_words").agg(F.min("item").alias("item"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: SeedRule = SeedRule(), key: str = "doc_id",
               text: str = "text", item: str = "item_id") -> DataFrame:
    """One row per document and item it leaks: key, item, equal words of the overlap, words of the item."""
    items = written(benchmark_items(benchmark, rule, item), "benchmark-items")
    item_starts = starts(items.withColumnRenamed("item_words", "words"), rule, "item")
    seeds = windows(item_starts, rule, "item", "anchor").select(
        "item", "anchor", F.size("words").alias("item_size"), F.col("at").alias("item_at"), F.col("seed").alias("item_seed"),
        F.col("before").alias("item_before"))
    blocks = max(1, -(-seeds.count() // BLOCK_SEEDS))
    placed = starts(docs.select(F.col(key).alias(key), word_hashes(F.col(text)).alias("words")), rule, key)
    first = F.col("before").isNull() | F.col("item_before").isNull() | (F.col("before") != F.col("item_before"))
    shift = F.col("at") - F.col("item_at")
    laid = F.slice("words", F.greatest(shift, F.lit(0)) + 1, F.col("item_size") + F.least(shift, F.lit(0)))
    found = []
    for b in range(blocks):
        block = seeds.where(F.pmod(F.xxhash64("item", "item_at", "item_seed"), F.lit(blocks)) == b)
        likely = placed.join(F.broadcast(block.select("anchor").distinct()), "anchor", "left_semi")
        found.append(windows(likely, rule, key).join(F.broadcast(block.drop("anchor")), (F.col("seed") == F.col("item_seed")) & first)
                     .select(key, "item", F.greatest(-shift, F.lit(0)).alias("skipped"), laid.alias("laid")))
    hits = reduce(DataFrame.union, found).join(small(items), "item")
    hits = hits.select(key, "item", overlap(F.col("laid"), F.col("item_words"), F.col("skipped"), rule.miss).alias("equal"),
                       F.size("item_words").alias("item_size"))
    need = F.least(F.lit(rule.least), F.ceil(F.col("item_size") * rule.percent / 100))
    leaks = hits.where(F.col("equal") >= need)
    return leaks.groupBy(key, "item").agg(F.max("equal").alias("equal"), F.max("item_size").alias("item_size"))


def mark_leaks(docs: DataFrame, benchmark: DataFrame, rule: SeedRule = SeedRule(), key: str = "doc_id", **names: str) -> DataFrame:
    """Per row: key, contaminated, n_items and the sorted ids of the leaked items."""
    leaks = find_leaks(docs, benchmark, rule, key, **names)
    by_doc = leaks.groupBy(F.col(key).alias("_leak_key")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    return docs.select(key).join(by_doc, F.col(key).eqNullSafe(F.col("_leak_key")), "left").select(
        key, F.col("items").isNotNull().alias("contaminated"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), "items")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rule: SeedRule = SeedRule(), key: str = "doc_id") -> DataFrame:
    """The rows of `docs` that leak no item, with all their columns."""
    leaks = written(find_leaks(docs, benchmark, rule, key).select(F.col(key).alias("_leak_key")).distinct(), "leaks")
    return docs.join(small(leaks), docs[key].eqNullSafe(leaks["_leak_key"]), "left_anti")
