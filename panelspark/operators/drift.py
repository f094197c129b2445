"""Zone and wave roll-ups of importance: rankings, drift tables, bands, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark import spec
from panelspark.functions.columns import absolute_gap, wave_label


def zone_means(by_feature: DataFrame, value: str = "importance", by: Sequence[str] = ("wave", "zone")) -> DataFrame:
    """Mean importance per wave, zone and feature, with the households behind it."""
    known = by_feature.where(F.col("zone").isNotNull())
    return known.groupBy(*by, "feature").agg(F.avg(value).alias("mean_importance"),
                                             F.count(F.lit(1)).alias("n_households"))


def without_features(df: DataFrame, names: Sequence[str] = spec.GEO_FEATURES) -> DataFrame:
    """Drop features from a long table after attribution; nothing is refitted."""
    return df.where(~F.col("feature").isin(*names))


def overall(zone_table: DataFrame, by: Sequence[str] = ("wave",)) -> DataFrame:
    """Unweighted mean over zones of the zone means."""
    return zone_table.groupBy(*by, "feature").agg(F.avg("mean_importance").alias("importance"))


def value_counts(df: DataFrame, column: str, n: str = "n", share: str = "share") -> DataFrame:
    """Rows per value and their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(n))
    return counts.withColumn(share, F.col(n) / F.sum(n).over(Window.partitionBy()))  # one row per value


def top_features(zone_table: DataFrame, k: int = 5, by: Sequence[str] = ("wave", "zone")) -> DataFrame:
    """The k most important features of each zone, ranked."""
    w = Window.partitionBy(*by).orderBy(F.desc("mean_importance"), "feature")
    return zone_table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_feature_grid(ranked: DataFrame, k: int = 5, by: Sequence[str] = ("wave", "zone")) -> DataFrame:
    """Ranked features laid out as one column per rank."""
    wide = ranked.groupBy(*by).pivot("rank", list(range(1, k + 1))).agg(F.first("feature"))
    return wide.withColumnsRenamed({str(i): f"rank_{i}" for i in range(1, k + 1)})


def feature_by_wave(overall_table: DataFrame, waves: Sequence[int]) -> DataFrame:
    """One row per feature, one column per wave; a feature a wave lacks is NULL there."""
    wide = overall_table.groupBy("feature").pivot("wave", list(waves)).agg(F.first("importance"))
    return wide.withColumnsRenamed({str(w): f"w{w}" for w in waves})


def best_wave(overall_table: DataFrame) -> DataFrame:
    """The largest importance any wave gives each feature."""
    return overall_table.groupBy("feature").agg(F.max("importance").alias("best"))


def feature_ranks(scores: DataFrame, score: str, name: str = "position") -> DataFrame:
    """Position of each feature by falling score; one row per feature, so the window is small."""
    return scores.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), "feature")))


def drift_table(overall_table: DataFrame, waves: Sequence[int]) -> DataFrame:
    """Feature x wave importance, ranked by each feature's best wave."""
    known = overall_table.where(F.col("wave").isin(*waves))
    wide = feature_by_wave(known, waves)
    columns = [F.col(f"w{w}") for w in waves]
    best = F.greatest(*columns) if len(columns) > 1 else columns[0]
    return feature_ranks(wide.withColumn("best", best), "best").orderBy("position")


def top_and_kept(ranks: DataFrame, n: int, keep: Sequence[str] = spec.HIGHLIGHT_FEATURES) -> DataFrame:
    """The first n features plus those that are always shown, flagged."""
    return ranks.where((F.col("position") <= n) | F.col("feature").isin(*keep)).withColumn(
        "highlighted", F.col("feature").isin(*keep))


def first_last_value(overall_table: DataFrame) -> DataFrame:
    """First and last wave with a value, and these values, per feature."""
    known = overall_table.where(F.col("importance").isNotNull())
    return known.groupBy("feature").agg(
        F.min("wave").alias("first_wave"), F.min_by("importance", "wave").alias("first_value"),
        F.max("wave").alias("last_wave"), F.max_by("importance", "wave").alias("last_value"))


def spread_band(by_feature: DataFrame, features: Sequence[str], value: str = "importance") -> DataFrame:
    """Household mean per wave with a band of one sample standard deviation."""
    picked = by_feature.where(F.col("feature").isin(*features))
    stats = picked.groupBy("wave", "feature").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return stats.withColumns({"lower": F.col("mean") - F.col("std"), "upper": F.col("mean") + F.col("std"),
                              "label": wave_label(F.col("wave"), spec.WAVE_YEARS)})


def convergence(overall_table: DataFrame, a: str, b: str) -> DataFrame:
    """Two features side by side per wave with their gap."""
    def pick(name):
        return F.max(F.when(F.col("feature") == name, F.col("importance"))).alias(name)

    both = overall_table.where(F.col("feature").isin(a, b)).groupBy("wave").agg(pick(a), pick(b))
    return both.withColumn("gap", absolute_gap(F.col(a), F.col(b)))


def zone_counts_by_wave(households: DataFrame, waves: Sequence[int]) -> DataFrame:
    """Households per zone, one column per wave."""
    known = households.where(F.col("zone").isNotNull())
    wide = known.groupBy("zone").pivot("wave", list(waves)).agg(F.count(F.lit(1)))
    return wide.withColumnsRenamed({str(w): f"w{w}" for w in waves}).fillna(0)


def distribution(by_feature: DataFrame, ranks: DataFrame, n: int) -> DataFrame:
    """Household-level rows of the n leading features."""
    # At most n rows.
    lead = ranks.where(F.col("position") <= n).select("feature")
    return by_feature.join(F.broadcast(lead), "feature", "left_semi")


def zone_summary(zone_table: DataFrame, counts: DataFrame, zones: Sequence[str], k: int = 5) -> DataFrame:
    """Chosen zones in display order: counts and leading features."""
    picked = zone_table.where(F.col("zone").isin(*zones))
    grid = top_feature_grid(top_features(picked, k, ["zone"]), k, ["zone"])
    return counts.where(F.col("zone").isin(*zones)).join(grid, "zone", "left").orderBy("zone_rank")
