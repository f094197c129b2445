"""Seeded splits, folds and samples that do not depend on partitioning.

Every draw ranks households by a number computed from their id. Ranks inside a
group that may hold most of the data are computed in slices of that number:
slice totals give each slice its offset, so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.columns import hashed_key

KEY_RANGE = 2147483648


def ranked(df: DataFrame, key: str, seed: int, by: Sequence[str] = (), slices: int = 4096,
           key_fn: Callable[[Column, int], Column] = hashed_key) -> DataFrame:
    """Add `draw_rank` (1, 2, ... by drawn number, then id) and `draw_total` per group.

    The result equals `row_number` over the whole group. `slices` bounds the
    rows of a task to about 1/slices of the largest group.
    """
    drawn = df.withColumn("_draw", key_fn(F.col(key), seed)).withColumn(
        "_slice", F.floor(F.col("_draw") / F.lit(KEY_RANGE / slices)).cast("int"))
    # Groups as text, so that a missing group joins like any other and the partitioning is reused.
    groups = {f"_g{i}": F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for i, c in enumerate(by)}
    drawn = drawn.withColumns(groups) if groups else drawn
    keys = [*groups, "_slice"]
    totals = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # The offsets table has at most slices x groups rows.
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(*groups)).alias("draw_total"))
    inner = drawn.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("_draw", key)))
    joined = inner.join(offsets, keys)
    return joined.withColumn("draw_rank", (F.col("_offset") + F.col("_rn")).cast("bigint")).select(
        *df.columns, "draw_rank", "draw_total")


def split(df: DataFrame, key: str, seed: int, test_size: float = 0.3, stratify: str | None = None,
          key_fn: Callable[[Column, int], Column] = hashed_key) -> DataFrame:
    """Add `is_test`: the first ceil(test_size x n) ranks, per class if `stratify` is given."""
    r = ranked(df, key, seed, [stratify] if stratify else [], key_fn=key_fn)
    return r.withColumn("is_test", F.col("draw_rank") <= F.ceil(F.col("draw_total") * F.lit(test_size))).drop(
        "draw_rank", "draw_total")


def folds(df: DataFrame, key: str, seed: int, k: int, stratify: str | None = None,
          key_fn: Callable[[Column, int], Column] = hashed_key) -> DataFrame:
    """Add `fold` in 0..k-1, spread evenly over the ranks of each class."""
    r = ranked(df, key, seed, [stratify] if stratify else [], key_fn=key_fn)
    return r.withColumn("fold", ((F.col("draw_rank") - 1) % k).cast("int")).drop("draw_rank", "draw_total")


def sample_per_group(df: DataFrame, key: str, group: str, n: int, seed: int,
                     key_fn: Callable[[Column, int], Column] = hashed_key) -> DataFrame:
    """At most `n` rows of each known group, drawn by id.

    Up to the window-group-limit threshold Spark keeps only `n` rows per group
    and task before the shuffle; larger draws rank in slices.
    """
    known = df.where(F.col(group).isNotNull())
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        return ranked(known, key, seed, [group], key_fn=key_fn).where(F.col("draw_rank") <= n).drop(
            "draw_rank", "draw_total")
    w = Window.partitionBy(group).orderBy(key_fn(F.col(key), seed), F.col(key))
    return known.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sample_rows(df: DataFrame, key: str, n: int, seed: int,
                key_fn: Callable[[Column, int], Column] = hashed_key) -> DataFrame:
    """`n` rows drawn by id; each task keeps its own best `n`."""
    return df.orderBy(key_fn(F.col(key), seed), F.col(key)).limit(n)


def random_label(key: Column, seed: int, key_fn: Callable[[Column, int], Column] = hashed_key) -> Column:
    """A 0/1 label that only depends on the id."""
    return (key_fn(key, seed) >= KEY_RANGE // 2).cast("int")


def run_numbers(runs: DataFrame, seed: str = "seed") -> DataFrame:
    """Number the runs of an experiment, one row per seed, from 1."""
    return runs.withColumn("run", F.row_number().over(Window.orderBy(seed)).cast("bigint"))
