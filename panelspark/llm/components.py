"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node` and `component` (least node) of every node that is not the least of its component.

    Alternates large-star and small-star steps until nothing changes, which takes
    about the logarithm of the longest path. A step groups by node with partial
    aggregation; each is written to the shared folder, so a lost executor costs
    no earlier step. Edges with a null end and loops are ignored.
    """
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    now = written(edges.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if tuple(state) == before or state[0] == 0:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = tuple(state)
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(parent, "u").where("v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        kept = parent.select(F.col("u").alias("hi"), F.col("m").alias("lo"))
        now = written(moved.union(kept).distinct(), "edges")
