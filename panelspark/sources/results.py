"""Result tables: one folder per table, one partition per wave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet") -> str:
    """Write one result table; rewriting a wave leaves the other waves alone."""
    path = f"{root}/{name}"
    by_wave = "wave" in df.columns
    # Rebalancing gathers each wave's rows into few files and splits a wave that is large.
    writer = (df.hint("rebalance", "wave") if by_wave else df).write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic").option("header", "true")
    if by_wave:
        writer = writer.partitionBy("wave")
    writer.format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    return {name: write_table(df, root, name, fmt) for name, df in tables.items()}


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        reader = reader.option("header", "true")
        if schema is None:
            reader = reader.option("inferSchema", "true")
    return reader.format(fmt).load(f"{root}/{name}")


def available_waves(results: DataFrame) -> DataFrame:
    """Waves that have results; on a wave-partitioned table only partitions are read."""
    return results.select("wave").distinct()


def setting(settings: DataFrame, name: str) -> Column:
    """One value of a `(setting, value)` table as a scalar column."""
    return settings.where(F.trim("setting") == name).agg(F.max("value")).scalar()
