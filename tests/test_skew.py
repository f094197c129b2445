"""One key may hold a third of the rows: results stay whole and no operator gathers a key's rows."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import assemble, metrics, sampling
from panelspark.runtime import bounded_rows


@pytest.fixture(scope="module")
def members(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("hh"),
        (30_000 - F.col("id")).cast("int").alias("member"), (F.col("id") % 80).cast("int").alias("age"))
    return rows.where("member <> 1")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_head_of_a_hot_household(members):
    heads = assemble.head_rows(members, "hh", "member", ["member"], ["age", "member"])
    hot = heads.where("hh = 0").first()
    assert hot["household_size"] == 10_000 and hot["member"] == 3
    assert heads.agg(F.sum("household_size")).first()[0] == members.count()
    plan = _plan(heads)
    assert "partial_min" in plan and "partial_count" in plan and "Window" not in plan


def test_hot_group_is_ranked_in_slices(members):
    rows = members.withColumn("g", (F.col("hh") == 0).cast("int"))
    ranked = sampling.ranked(rows, "member", 1, ["g"], slices=64)
    stats = ranked.groupBy("g").agg(F.count("*").alias("n"), F.max("draw_rank").alias("top"),
                                    F.count_distinct("draw_rank").alias("distinct")).collect()
    assert all(r["n"] == r["top"] == r["distinct"] for r in stats)
    assert "hashpartitioning(_g0" in _plan(ranked) and "_slice" in _plan(ranked)


def test_hot_score_collapses_before_ranking(members):
    scored = members.select((F.col("age") > 40).cast("int").alias("y"), F.when(F.col("hh") == 0, 0.5).otherwise(
        F.col("member") / 30_000).alias("s"))
    auc = metrics.rank_auc(scored, "s", F.col("y") == 1)
    assert 0 < auc.first()["auc"] < 1 and "partial_sum" in _plan(auc)


def test_bounded_rows_refuses_large_tables(members):
    with pytest.raises(ValueError, match="more than 10 rows"):
        bounded_rows(members, 10, "members")
