"""Queries over quality checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark import spec
from panelspark.functions import columns as fc
from panelspark.operators import drift, encode, harmonize, quality, sampling, zones
from panelspark.plans import panel
from panelspark.plans.panel import sql_key, table, with_sql
from panelspark.plans.queries_relational import importance, r6, zone_table
from panelspark.plans.registry import query
from panelspark.runtime import cut_lineage, scratch_path
from panelspark.sources import results

FT = panel.SQL_FEATURES
IMP = panel.SQL_IMPORTANCE
_ANSWERS = ["head_age", "rooms", "household_size", *panel.CODES]


@query("q1_missing_rate", with_sql(f"""
SELECT wave, feature, round(avg(CAST(v IS NULL AS DOUBLE)), 6) + 0.0 AS missing_rate FROM (
  SELECT wave, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _ANSWERS)} FROM ft)
UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_ANSWERS)})) GROUP BY ALL""", FT))
def missing_rate(spark, sf):
    return encode.missing_rates(panel.features(spark, sf), _ANSWERS).withColumn(
        "missing_rate", r6(F.col("missing_rate")))


@query("q2_uncovered_codes", """
SELECT CAST(c_nationkey AS BIGINT) AS region_code, count(*) AS n FROM customer
WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')
GROUP BY 1""")
def uncovered_codes(spark, sf):
    known = panel.zones(spark, sf).where("zone <> 'ASIA'")
    return zones.uncovered_codes(table(spark, sf, "customer"), "c_nationkey", known)


@query("q3_code_set_changes", """
WITH l AS (SELECT event_type AS feature, k AS code, min(v) FILTER (early) AS label_before,
                  min(v) FILTER (NOT early) AS label_after
           FROM (SELECT event_type, 'k' || json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS v,
                        hour(ts) < 12 AS early FROM events) GROUP BY ALL)
SELECT *, CASE WHEN label_before IS NULL THEN 'added' WHEN label_after IS NULL THEN 'dropped'
               WHEN label_before <> label_after THEN 'relabelled' ELSE 'same' END AS change FROM l""")
def code_set_changes(spark, sf):
    events = table(spark, sf, "events").select(
        "event_type", F.hour("ts").alias("h"), F.col("user_id").cast("string").alias("user"), "props")
    parsed = harmonize.labels_from_json(events.withColumn("event_type", F.concat_ws(
        "|", "event_type", F.col("h").cast("string"), "user")), "event_type", "props")
    parts = F.split("feature", "\\|")
    coded = parsed.select(parts[0].alias("feature"), F.concat("code", "label").alias("code"),
                          parts[1].cast("int").alias("h"), parts[2].alias("label"))

    def labels(condition):
        return coded.where(condition).groupBy("feature", "code").agg(F.min("label").alias("label"))

    return harmonize.code_set_changes(labels("h < 12"), labels("h >= 12"))


@query("q4_reaggregation", with_sql("""
SELECT wave, count(*) AS n_cells, true AS same FROM zt GROUP BY wave""", IMP))
def reaggregation(spark, sf):
    root = scratch_path(spark, "stored")
    results.write_table(zone_table(spark, sf), root, "zone_x_feature")
    stored = results.read_table(spark, root, "zone_x_feature")
    gaps = quality.reaggregation(stored, importance(spark, sf))
    return gaps.select("wave", "n_cells", (F.col("max_diff") <= 1e-9).alias("same"))


def _scores(spark, sf):
    """Linear score of each household, a missing answer counted as the wave's mean, and the wave's base."""
    x = panel.design(spark, sf)
    weights = panel.score_weights()
    total = sum((F.coalesce(F.col(c), F.col(f"m_{c}")) * w for c, w in weights.items()), F.lit(0.0))
    base = sum((F.col(f"m_{c}") * w for c, w in weights.items()), F.lit(0.0))
    return x.join(panel.wave_means(x), "wave").select("hhid", "wave", base.alias("base"), total.alias("score"))


@query("q5_additivity", with_sql("""
SELECT wave, count(*) AS n_explained, true AS additive, round(avg(score), 6) + 0.0 AS mean_score FROM (
  SELECT x.wave, {score} AS score FROM x JOIN m ON x.wave = m.wave) GROUP BY wave""".format(
    score=" + ".join(f"coalesce({c}, m_{c}) * {w!r}" for c, w in panel.score_weights().items())), panel.SQL_ATTRIBUTION))
def additivity(spark, sf):
    x = panel.design(spark, sf)
    weights = panel.score_weights()
    wide = x.join(panel.wave_means(x), "wave")
    total = sum((F.coalesce(F.col(c), F.col(f"m_{c}")) * w for c, w in weights.items()), F.lit(0.0))
    base = sum((F.col(f"m_{c}") * w for c, w in weights.items()), F.lit(0.0))
    phi = panel.attribution_columns()
    summed = sum((p for p in phi.values()), F.lit(0.0))
    gaps = wide.select("wave", total.alias("score"), F.abs(summed + base - total).alias("gap"))
    return gaps.groupBy("wave").agg(F.count(F.lit(1)).alias("n_explained"), (F.max("gap") <= 1e-2).alias("additive"),
                                    r6(F.avg("score")).alias("mean_score"))


def _explained(spark, sf, n=30):
    """Sampled households of every wave and zone, as an explanation run would pick them."""
    ft = panel.features(spark, sf).where("zone is not null").select("hhid", "wave", "zone")
    tagged = ft.withColumn("stratum", F.concat_ws("/", F.col("wave").cast("string"), "zone"))
    return sampling.sample_per_group(tagged, "hhid", "stratum", n, 42, fc.arithmetic_key).drop("stratum")


_SQL_EXPLAINED = f"""{FT},
ex AS (SELECT wave, zone, least(count(*), 30) AS n_explained FROM ft WHERE zone IS NOT NULL GROUP BY ALL)"""


@query("q6_sample_counts", with_sql("""
SELECT wave, count(*) FILTER (n_explained < 30) AS below_cap, count(DISTINCT n_explained) > 1 AS uneven,
       min(n_explained) AS least FROM ex GROUP BY wave""", _SQL_EXPLAINED))
def sample_counts(spark, sf):
    counts = _explained(spark, sf).groupBy("wave", "zone").agg(F.count(F.lit(1)).alias("n_explained"))
    return quality.sample_counts(counts, 30)


@query("q7_forbidden_features", with_sql("""
SELECT wave, 'full' AS result, count(*) FILTER (feature = 'rural_urban') AS n_forbidden FROM zt GROUP BY wave
UNION ALL SELECT wave, 'no_geo', 0 FROM zt GROUP BY wave""", IMP))
def forbidden_features(spark, sf):
    zt = zone_table(spark, sf)
    full = quality.forbidden_features(zt, spec.GEO_FEATURES)
    bare = quality.forbidden_features(drift.without_features(zt), spec.GEO_FEATURES)
    return full.withColumn("result", F.lit("full")).unionByName(bare.withColumn("result", F.lit("no_geo")))


@query("q8_locked_values", with_sql("""
SELECT wave, metric, locked, value, abs(value - locked) <= 0.05 AS ok FROM (
  SELECT wave, 'mean_age' AS metric, round(avg(head_age), 6) + 0.0 AS value, round(avg(head_age), 1) + 0.0 AS locked
  FROM ft GROUP BY wave
  UNION ALL SELECT wave, 'mean_size', round(avg(household_size), 6) + 0.0, round(avg(household_size), 0) + 0.0
  FROM ft GROUP BY wave)""", FT))
def locked_values(spark, sf):
    ft = panel.features(spark, sf)
    current = ft.groupBy("wave").agg(r6(F.avg("head_age")).alias("mean_age"),
                                     r6(F.avg("household_size")).alias("mean_size")).unpivot(
        ["wave"], ["mean_age", "mean_size"], "metric", "value")
    digits = F.when(F.col("metric") == "mean_age", F.round("value", 1)).otherwise(F.round("value", 0))
    locked = current.select("wave", "metric", (digits + 0.0).alias("value"))
    return quality.locked_values(current, locked, 0.05)


@query("q9_same_twice", with_sql("SELECT 'both' AS run, count(*) AS n_rows, 0 AS n_differing FROM head", panel.SQL_HEADS))
def same_twice(spark, sf):
    """The head row by aggregation and by window must be the same rows."""
    one = panel.heads(spark, sf).drop("household_size")
    w = Window.partitionBy("l_orderkey").orderBy(F.when(F.col("l_linenumber") == 1, 0).otherwise(1),
                                                 *panel.MEMBER_ORDER)
    two = table(spark, sf, "lineitem").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*one.columns)
    differing = quality.differing_rows(one, two).agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    return one.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit("both").alias("run"), "n_rows",
                                                            differing.alias("n_differing"))


@query("q10_report", with_sql("""
SELECT wave, 'reaggregation' AS "check", 'PASS' AS status, 'cells=' || count(*) AS detail FROM zt GROUP BY wave
UNION ALL SELECT wave, 'no_geo', 'PASS', 'n=0' FROM zt GROUP BY wave
UNION ALL SELECT wave, 'sample_cap', CASE WHEN min(n_explained) < 30 THEN 'FAIL' ELSE 'PASS' END,
                 'least=' || min(n_explained) FROM ex GROUP BY wave""", IMP + """,
ex AS (SELECT wave, zone, least(count(*), 30) AS n_explained FROM ft WHERE zone IS NOT NULL GROUP BY ALL)"""))
def quality_report(spark, sf):
    rows = cut_lineage(importance(spark, sf))
    zt = drift.zone_means(rows)
    gaps = quality.reaggregation(zt, rows)
    bare = quality.forbidden_features(drift.without_features(zt), spec.GEO_FEATURES)
    counts = sample_counts(spark, sf)
    return quality.report(
        quality.check(gaps, "reaggregation", F.col("max_diff") > 1e-9, F.concat(F.lit("cells="), F.col("n_cells"))),
        quality.check(bare, "no_geo", F.col("n_forbidden") > 0, F.concat(F.lit("n="), F.col("n_forbidden"))),
        quality.check(counts, "sample_cap", F.col("below_cap") > 0, F.concat(F.lit("least="), F.col("least"))))
