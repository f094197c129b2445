"""Zones of households, zone counts and uncovered codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import rounded_code


def attach_zone(df: DataFrame, zones: DataFrame, code: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Add `zone` and `zone_rank`; unknown codes and excluded zones are NULL.

    `zones` is a dimension `(region_code, zone, zone_rank)`; Spark broadcasts it
    while it is small and shuffles it when it is not.
    """
    keep = zones.where(~F.col("zone").isin(*excluded)) if excluded else zones
    joined = df.withColumn("_code", rounded_code(F.col(code), df.schema[code].dataType))
    return joined.join(keep.withColumn("_code", F.col("region_code").cast("bigint")).drop("region_code"),
                       "_code", "left").drop("_code")


def zone_list(zones: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Distinct zones with their display rank."""
    keep = zones.where(~F.col("zone").isin(*excluded)) if excluded else zones
    return keep.select("zone", "zone_rank").distinct()


def conform(zones: DataFrame, table: DataFrame, on: str = "zone", fill: dict | None = None) -> DataFrame:
    """Lay a small table over a fixed list of zones; absent counts become the fill value."""
    joined = zones.join(table, on, "left")
    return joined.fillna(fill) if fill else joined


def zone_counts(households: DataFrame, explained: DataFrame, zones: DataFrame) -> DataFrame:
    """`(zone, zone_rank, n_total, n_explained)` over a zone list, zeros kept."""
    total = households.where(F.col("zone").isNotNull()).groupBy("zone").agg(F.count(F.lit(1)).alias("n_total"))
    seen = explained.where(F.col("zone").isNotNull()).groupBy("zone").agg(F.count(F.lit(1)).alias("n_explained"))
    return conform(conform(zones, total), seen, fill={"n_total": 0, "n_explained": 0})


def uncovered_codes(df: DataFrame, code: str, zones: DataFrame) -> DataFrame:
    """Distinct codes in the data that no zone claims, with their row counts."""
    counted = (df.where(F.col(code).isNotNull())
               .groupBy(rounded_code(F.col(code), df.schema[code].dataType).alias("region_code")).agg(F.count(F.lit(1)).alias("n")))
    return counted.join(zones.select(F.col("region_code").cast("bigint").alias("region_code")),
                        "region_code", "left_anti")
