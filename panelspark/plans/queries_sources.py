"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.columns import to_number
from panelspark.operators import assemble
from panelspark.plans import panel
from panelspark.plans.panel import table, with_sql
from panelspark.plans.registry import query
from panelspark.runtime import scratch_path
from panelspark.sources import results, sections


@query("s1_section_scan", """
SELECT c_custkey AS hhid, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def section_scan(spark, sf):
    path = scratch_path(spark, "section")
    table(spark, sf, "customer").write.option("header", "true").csv(path)
    raw = sections.read_csv(spark, path)
    return raw.select(to_number(F.col("c_custkey")).cast("bigint").alias("hhid"),
                      to_number(F.col("c_acctbal")).alias("balance"), F.col("c_mktsegment").alias("segment"))


_WAVE_COLUMNS = {1: {"sjq8": "water_source", "locality": "rural_urban"},
                 2: {"hh_j19": "water_source", "y2_rural": "rural_urban"}}
_LATER_COLUMNS = {"hh_i19": "water_source", "clustertype": "rural_urban", "hh_i15": "child_stool_disposal"}


@query("s3_waves_union", with_sql("""
SELECT hhid, wave, water_source, rural_urban, CASE WHEN wave > 2 THEN segment END AS child_stool_disposal
FROM hh""", panel.SQL_HOUSEHOLDS))
def waves_union(spark, sf):
    hh = panel.households(spark, sf)
    canonical = {"water_source": "water_source", "rural_urban": "rural_urban", "child_stool_disposal": "segment"}
    tables = {}
    for wave in panel.WAVES:
        columns = _WAVE_COLUMNS.get(wave, _LATER_COLUMNS)
        raw = hh.where(F.col("wave") == wave).select(
            "hhid", *[F.col(canonical[feature]).alias(name) for name, feature in columns.items()])
        tables[wave] = raw.withColumnsRenamed(columns)
    return sections.union_waves(tables)


@query("s4_shared_section", with_sql("""
SELECT hhid, household_size, l_quantity AS head_age, l_returnflag AS education FROM head""", panel.SQL_HEADS))
def shared_section(spark, sf):
    """Both sections read the same file, so one aggregation finds the head row of both."""
    heads = assemble.head_rows(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", panel.MEMBER_ORDER,
                               ["l_quantity", "l_returnflag"])
    return heads.select(F.col("l_orderkey").alias("hhid"), "household_size", F.col("l_quantity").alias("head_age"),
                        F.col("l_returnflag").alias("education"))


def _zone_table(spark, sf):
    return (panel.features(spark, sf).where(F.col("zone").isNotNull()).groupBy("wave", "zone")
            .agg(F.count(F.lit(1)).alias("n_households"),
                 (F.round(F.avg("head_age"), 6) + 0.0).alias("mean_age")))


_ZONE_SQL = """
SELECT wave, zone, count(*) AS n_households, round(avg(head_age), 6) + 0.0 AS mean_age
FROM ft WHERE zone IS NOT NULL GROUP BY wave, zone"""


@query("s5_read_results", with_sql(f"""
SELECT f.fmt, z.* FROM ({_ZONE_SQL}) z, (VALUES ('csv'), ('parquet')) f(fmt)""", panel.SQL_FEATURES))
def read_results(spark, sf):
    root = scratch_path(spark, "results")
    zone = _zone_table(spark, sf)
    schema = "zone string, n_households bigint, mean_age double, wave int"
    read = None
    for fmt in ("csv", "parquet"):
        results.write_table(zone, root, f"zone_{fmt}", fmt)
        part = results.read_table(spark, root, f"zone_{fmt}", fmt, schema).select(F.lit(fmt).alias("fmt"), "*")
        read = part if read is None else read.unionByName(part)
    return read


@query("s6_available_waves", with_sql("SELECT DISTINCT wave FROM hh", panel.SQL_HOUSEHOLDS))
def available_waves(spark, sf):
    root = scratch_path(spark, "waves")
    results.write_table(_zone_table(spark, sf), root, "zone")
    return results.available_waves(results.read_table(spark, root, "zone"))


@query("s7_write_households", with_sql("""
SELECT hhid, wave, household_size, head_age FROM ft""", panel.SQL_FEATURES))
def write_households(spark, sf):
    root = scratch_path(spark, "households")
    rows = panel.features(spark, sf).select("hhid", "wave", "household_size", "head_age")
    results.write_table(rows, root, "households", "csv")
    return results.read_table(spark, root, "households", "csv",
                              "hhid bigint, household_size bigint, head_age double, wave int")


@query("s8_write_bundle", with_sql("""
SELECT 'households' AS result, count(*) AS n_rows FROM ft
UNION ALL SELECT 'zone', count(*) FROM (SELECT DISTINCT wave, zone FROM ft)
UNION ALL SELECT 'waves', count(DISTINCT wave) FROM ft""", panel.SQL_FEATURES))
def write_bundle(spark, sf):
    root = scratch_path(spark, "bundle")
    ft = panel.features(spark, sf)
    tables = {"households": ft.select("hhid", "wave", "zone"), "zone": _zone_table(spark, sf),
              "waves": ft.groupBy("wave").agg(F.count(F.lit(1)).alias("n"))}
    results.write_tables(tables, root)
    counts = None
    for name in tables:
        one = results.read_table(spark, root, name).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("result"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("s10_setting_lookup", with_sql("""
SELECT zone, count(*) AS n, round(count(*) / (SELECT count(*) FROM hh), 6) + 0.0 AS share
FROM ft GROUP BY zone""", panel.SQL_FEATURES))
def setting_lookup(spark, sf):
    ft = panel.features(spark, sf)
    settings = panel.households(spark, sf).agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("n_households").alias("setting"), "value")
    total = results.setting(settings, "n_households").cast("double")
    return ft.groupBy("zone").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share", F.round(F.col("n") / total, 6) + 0.0)
