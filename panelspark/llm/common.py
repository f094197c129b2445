"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.runtime import scratch_path

#: Rows up to which a table with one row per group, rule or seed may be broadcast.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: read many times, computed once, kept if an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it is proven to have at most `limit` rows; else left to a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not use yet, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def uniform(*parts: Column | str) -> Column:
    """A draw in (0, 1) from the MD5 of the parts joined by `|`; null counts as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Stretches of the batches with about `limit` bytes of text in a column, or one longer row.

    What a task has freed goes back to the machine when its rows are through:
    Python workers stay alive between tasks, beside the heap of their executor.
    """
    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(sizes), 0
            if not batch.num_rows:
                yield batch
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] - sizes[start] + limit, side="right")))
                yield batch.slice(start, end - start)
                start = end
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory of this process to the machine, where the platform can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
