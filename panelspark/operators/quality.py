"""Checks of inputs and results, and the PASS/FAIL report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, name: str, bad: Column, detail: Column, by: str = "wave") -> DataFrame:
    """One `(by, check, status, detail)` row per row of a small result."""
    return df.select(F.col(by), F.lit(name).alias("check"),
                     F.when(F.coalesce(bad, F.lit(True)), "FAIL").otherwise("PASS").alias("status"),
                     detail.cast("string").alias("detail"))


def report(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def reaggregation(stored: DataFrame, by_feature: DataFrame, value: str = "importance") -> DataFrame:
    """Largest and mean gap per wave between stored zone means and means recomputed from households."""
    fresh = by_feature.where(F.col("zone").isNotNull()).groupBy("wave", "zone", "feature").agg(
        F.avg(value).alias("_fresh"))
    # A cell that only one side has counts as an infinite gap.
    gap = F.coalesce(F.abs(F.col("mean_importance") - F.col("_fresh")), F.lit(float("inf")))
    return stored.join(fresh, ["wave", "zone", "feature"], "full").groupBy("wave").agg(
        F.count(F.lit(1)).alias("n_cells"), F.max(gap).alias("max_diff"), F.avg(gap).alias("mean_diff"))


def additivity(attribution: DataFrame, scores: DataFrame, key: str = "hhid", by: Sequence[str] = ("wave",)) -> DataFrame:
    """Largest and mean gap between the sum of attributions plus base and the score.

    `scores` is `(key, by, base, score)`.
    """
    sums = attribution.groupBy(key).agg(F.sum("phi").alias("_sum"))
    gap = F.abs(F.col("_sum") + F.col("base") - F.col("score"))
    return scores.join(sums, key).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_explained"), F.max(gap).alias("max_dev"), F.avg(gap).alias("mean_dev"))


def sample_counts(counts: DataFrame, cap: int, n: str = "n_explained") -> DataFrame:
    """Per wave: zones below the cap, and whether zones differ in count."""
    return counts.groupBy("wave").agg(F.count_if(F.col(n) < cap).alias("below_cap"),
                                      (F.count_distinct(n) > 1).alias("uneven"), F.min(n).alias("least"))


def sample_targets(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Per wave: zones whose explained count is not what the run asked for, and the least count.

    `counts` is `(wave, zone, n_total, n_explained)` and `limits` is `(wave, cap)`,
    one row per wave. A zone is to hold its cap, or all its households where it
    has fewer; a NULL cap asks for all. Counts are uneven where zones that reach
    the cap differ; without a cap they may differ. A wave without limits is wrong
    in every zone.
    """
    known = F.col("_limited") & (F.col("n_explained") == F.least("cap", "n_total"))  # least skips NULL
    full = F.col("cap").isNotNull() & (F.col("n_total") >= F.col("cap"))
    return counts.join(limits.withColumn("_limited", F.lit(True)), "wave", "left").groupBy("wave").agg(
        F.count_if(~F.coalesce(known, F.lit(False))).alias("n_off"),
        (F.count_distinct(F.when(full, F.col("n_explained"))) > 1).alias("uneven"), F.min("n_explained").alias("least"))


def stored_households(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Per wave: cells of a stored zone table whose `n_households` is not the zone's explained count.

    `counts` is `(wave, zone, n_explained)`. A zone that only one side has counts
    as one wrong cell (zones without explained households need no cells), as does
    a NULL count.
    """
    explained = counts.where("n_explained > 0").select("wave", "zone", "n_explained")
    same = F.coalesce(F.col("n_households") == F.col("n_explained"), F.lit(False))
    return table.join(explained, ["wave", "zone"], "full").groupBy("wave").agg(F.count_if(~same).alias("n_wrong"))


def forbidden_features(table: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    """Forbidden features that a result still contains, per wave."""
    return table.groupBy("wave").agg(F.count_if(F.col("feature").isin(*forbidden)).alias("n_forbidden"))


def locked_values(current: DataFrame, locked: DataFrame, tolerance: float) -> DataFrame:
    """Compare `(wave, metric, value)` with locked values; a missing one fails."""
    joined = locked.withColumnRenamed("value", "locked").join(current, ["wave", "metric"], "left")
    within = F.abs(F.col("value") - F.col("locked")) <= tolerance
    return joined.select("wave", "metric", "locked", "value", F.coalesce(within, F.lit(False)).alias("ok"))


def differing_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of either run that the other lacks, with multiplicity."""
    return first.exceptAll(second).select(F.lit("first").alias("only_in"), "*").unionByName(
        second.exceptAll(first).select(F.lit("second").alias("only_in"), "*"))
