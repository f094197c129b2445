"""Queries over projections, filters, joins, aggregations, windows and reshapes."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark import spec
from panelspark.functions import columns as fc
from panelspark.operators import assemble, drift, encode, harmonize, sampling, zones
from panelspark.operators.explain import by_feature, by_feature_long, owner_feature
from panelspark.plans import panel
from panelspark.plans.panel import sql_key, table, with_sql
from panelspark.plans.registry import query
from panelspark.sources.sections import WaveLayout

FT = panel.SQL_FEATURES
IMP = panel.SQL_IMPORTANCE
FEATURES = list(panel.NUMERIC) + list(panel.CODES)
KNOWN = "WHERE zone IS NOT NULL"


def r6(col):
    return F.round(col, 6) + 0.0


def importance(spark, sf):
    return by_feature(panel.attribution_wide(spark, sf), list(panel.score_weights()), FEATURES)


def zone_table(spark, sf):
    return drift.zone_means(importance(spark, sf))


def overall(spark, sf):
    return drift.overall(zone_table(spark, sf))


# ---- projections -----------------------------------------------------------

# The part table as a dwelling section of wave 1, which lacks one feature.
_DWELLING = WaveLayout(1, "p_partkey", "", {}, {"hh_i09": "p_size", "hh_i10": "p_type", "hh_i15": None,
                                               "hh_i19": "p_brand"})


@query("p2_resolve_columns", "SELECT p_partkey, p_size, p_type, p_brand FROM part")
def resolve_columns(spark, sf):
    part = table(spark, sf, "part")
    wanted = [_DWELLING.columns.get(f.column, f.column) for f in spec.features_by_section()["I"]]
    return part.select("p_partkey", *[c for c in wanted if c and c in part.columns])


@query("p3_present_columns", "SELECT p_partkey, p_brand, p_size, p_type FROM part")
def present_columns(spark, sf):
    part = table(spark, sf, "part")
    found = assemble.present_columns(part.columns, spec.FEATURES, _DWELLING)
    return part.select("p_partkey", *found)


@query("p4_bulk_rename", """
SELECT p_partkey AS hhid, p_size AS rooms, p_type AS floor_material, p_brand AS water_source FROM part""")
def bulk_rename(spark, sf):
    part = table(spark, sf, "part")
    found = assemble.present_columns(part.columns, spec.FEATURES, _DWELLING)
    return part.select("p_partkey", *found).withColumnsRenamed(found | {"p_partkey": "hhid"})


@query("p5_first_usable", with_sql("""
SELECT hhid, CASE WHEN (SELECT count(locality) FROM src) > 0 THEN locality
                  WHEN (SELECT count(clustertype) FROM src) > 0 THEN clustertype ELSE y4_rural END AS rural_urban
FROM src""", panel.SQL_HOUSEHOLDS + """,
src AS (SELECT hhid, CAST(NULL AS INTEGER) AS locality, CASE WHEN wave > 3 THEN rural_urban END AS clustertype,
               water_source AS y4_rural FROM hh)"""))
def first_usable(spark, sf):
    src = panel.households(spark, sf).select(
        "hhid", F.lit(None).cast("int").alias("locality"),
        F.when(F.col("wave") > 3, F.col("rural_urban")).alias("clustertype"), F.col("water_source").alias("y4_rural"))
    return src.select("hhid", F.col(assemble.first_usable(src, ["locality", "clustertype", "y4_rural"]))
                      .alias("rural_urban"))


_P6 = ["hhid", "household_size", "head_sex", "head_age", "floor_material", "water_source", "region", "rural_urban"]


@query("p6_column_order", with_sql(f"SELECT {', '.join(_P6)} FROM ft", FT))
def column_order(spark, sf):
    return assemble.ordered(panel.features(spark, sf), [*_P6[:2], *[f.name for f in spec.FEATURES
                                                                  if f.name in _P6], "not_asked"])


@query("p7_drop_columns", with_sql("SELECT * EXCLUDE (region, rural_urban, zone, zone_rank) FROM ft", FT))
def drop_columns(spark, sf):
    return panel.features(spark, sf).drop(*spec.GEO_FEATURES, "zone", "zone_rank")


# ---- scalars ---------------------------------------------------------------

_RAW = """CASE o_orderstatus WHEN 'P' THEN o_orderpriority WHEN 'F' THEN 'NaN'
               ELSE CAST(o_custkey AS VARCHAR) || '.5 ' END"""


def _raw_text():
    return (F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
            .when(F.col("o_orderstatus") == "F", "NaN")
            .otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".5 "))))


@query("x1_coerce_number", f"""
SELECT o_orderkey AS hhid, CASE WHEN NOT isnan(v) THEN v END AS value
FROM (SELECT o_orderkey, TRY_CAST(trim({_RAW}) AS DOUBLE) AS v FROM orders)""")
def coerce_number(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("hhid"),
                                             fc.to_number(_raw_text()).alias("value"))


def _raw_codes(spark, sf):
    ft = panel.features(spark, sf)
    return ft.select("hhid", "wave", F.col("rooms").alias("water_source"), F.col("head_age").alias("lighting_fuel"),
                     (F.col("rooms") / 4).alias("toilet_facility"), (F.col("rural_urban") - 1).alias("rural_urban"),
                     F.col("head_age").alias("education_level"))


_RAW_CODES_SQL = """
SELECT hhid, wave, rooms AS water_source, head_age AS lighting_fuel, rooms / 4 AS toilet_facility,
       CAST(rural_urban - 1 AS DOUBLE) AS rural_urban, head_age AS education_level FROM ft"""
_RECODED = ["water_source", "lighting_fuel", "toilet_facility", "rural_urban", "education_level"]


def _sql_recode(feature):
    waves = ""
    for wave, features in spec.CROSSWALK.items():
        if feature in features:
            whens = " ".join(f"WHEN {a} THEN {b}" for a, b in features[feature].items())
            code = f"CAST(trunc({feature}) AS BIGINT)"
            waves += f" WHEN {wave} THEN CAST(CASE {code} {whens} ELSE {code} END AS DOUBLE)"
    return f"CASE wave {waves} ELSE {feature} END AS {feature}"


@query("x2_recode", with_sql(
    f"SELECT hhid, wave, {', '.join(_sql_recode(f) for f in _RECODED)} FROM raw", f"{FT}, raw AS ({_RAW_CODES_SQL})"))
def recode(spark, sf):
    done = harmonize.harmonize_waves(_raw_codes(spark, sf), spec.CROSSWALK)
    return done.select("hhid", "wave", *[F.col(c).cast("double") for c in _RECODED])


_X3_SQL = """
c AS (SELECT c_custkey AS hhid, c_nationkey + c_acctbal - floor(c_acctbal) AS code FROM customer),
z AS (SELECT n_nationkey, r_name AS zone FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')"""


@query("x3_zone_of_code", with_sql("""
SELECT hhid, z.zone FROM c LEFT JOIN z ON z.n_nationkey = CAST(round_even(code, 0) AS BIGINT)""", _X3_SQL))
def zone_of_code(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("hhid"),
        (F.col("c_nationkey") + F.col("c_acctbal") - F.floor("c_acctbal")).alias("code"))
    return zones.attach_zone(c, panel.zones(spark, sf), "code", excluded=["ASIA"]).select("hhid", "zone")


@query("x4_zone_list", with_sql("""
SELECT zone, zone_rank, count(*) AS n FROM ft WHERE zone <> 'ASIA' GROUP BY zone, zone_rank""", FT))
def zone_list(spark, sf):
    listed = zones.zone_list(panel.zones(spark, sf), excluded=["ASIA"])
    counts = panel.features(spark, sf).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return zones.conform(listed, counts, fill={"n": 0}).orderBy("zone_rank")


@query("x5_owner_feature", with_sql("""
SELECT feature, count(*) AS n_columns, sum(n) AS n FROM (
  SELECT c, n, max_by(f, length(f)) AS feature FROM (
    SELECT c, n, f FROM (SELECT "column" AS c, count(*) AS n FROM phi GROUP BY 1) a
    JOIN (VALUES ('head'), ('head_age'), ('rural'), ('rural_urban'), ('floor'), ('floor_material'), ('water')) v(f)
      ON c = f OR starts_with(c, f || '_')) GROUP BY c, n
  UNION ALL
  SELECT "column", count(*), "column" FROM phi WHERE NOT regexp_matches("column", '^(head|rural|floor|water)_')
  GROUP BY 1) GROUP BY feature""".replace("sum(n)", "CAST(sum(n) AS BIGINT)"), panel.SQL_ATTRIBUTION))
def owner_of_column(spark, sf):
    known = ["head", "head_age", "rural", "rural_urban", "floor", "floor_material", "water"]
    per_column = panel.linear_attribution(spark, sf).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    return per_column.groupBy(owner_feature(F.col("column"), known).alias("feature")).agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n"))


@query("x6_arithmetic", """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 6) + 0.0 AS norm,
       round(abs(CAST(embedding[1] AS DOUBLE)), 4) + 0.0 AS first_abs FROM embeddings""")
def arithmetic(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", r6(fc.l2_norm(F.col("v"))).alias("norm"),
                    (F.round(F.abs(F.col("v")[0]), 4) + 0.0).alias("first_abs"))


@query("x7_missing_mask", with_sql("""
SELECT hhid, rooms IS NULL AS rooms_missing, electricity_source IS NULL AS electricity_missing FROM ft""", FT))
def missing_mask(spark, sf):
    return panel.features(spark, sf).select("hhid", F.col("rooms").isNull().alias("rooms_missing"),
                                            F.col("electricity_source").isNull().alias("electricity_missing"))


@query("x8_wave_label", with_sql("""
SELECT hhid, 'W' || wave || ' (' || CASE wave WHEN 1 THEN '2008/09' WHEN 2 THEN '2010/11' WHEN 3 THEN '2012/13'
       WHEN 4 THEN '2014/15' ELSE '2020/21' END || ')' AS label FROM hh""", panel.SQL_HOUSEHOLDS))
def wave_label(spark, sf):
    return panel.households(spark, sf).select("hhid", fc.wave_label(F.col("wave"), spec.WAVE_YEARS).alias("label"))


@query("x9_percent", """
SELECT l_orderkey AS hhid, l_linenumber, round(CASE WHEN v <= 1 THEN v * 100 ELSE v END, 6) + 0.0 AS percent
FROM (SELECT *, l_quantity * l_discount AS v FROM lineitem)""")
def percent(spark, sf):
    v = F.col("l_quantity") * F.col("l_discount")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hhid"), "l_linenumber",
                                               r6(fc.as_percent(v)).alias("percent"))


@query("x10_absolute_gap", with_sql("""
SELECT a.zone, a.wave, round(abs(a.mean_importance - b.mean_importance), 6) + 0.0 AS gap
FROM zt a JOIN zt b ON a.zone = b.zone AND a.wave = b.wave
WHERE a.feature = 'electricity_source' AND b.feature = 'rural_urban'""", IMP))
def gap(spark, sf):
    pair = zone_table(spark, sf).where(F.col("feature").isin(*spec.HIGHLIGHT_FEATURES))
    wide = pair.groupBy("zone", "wave").pivot("feature", list(spec.HIGHLIGHT_FEATURES)).agg(F.first("mean_importance"))
    return wide.select("zone", "wave", r6(fc.absolute_gap(F.col("electricity_source"), F.col("rural_urban")))
                       .alias("gap"))


@query("x11_membership_flag", with_sql("""
SELECT wave, zone, feature, feature IN ('electricity_source', 'rural_urban') AS highlighted FROM zt""", IMP))
def membership_flag(spark, sf):
    return zone_table(spark, sf).select("wave", "zone", "feature",
                                        F.col("feature").isin(*spec.HIGHLIGHT_FEATURES).alias("highlighted"))


@query("x12_clean_text", """
SELECT o_orderkey AS hhid, t AS name, contains(t, 'low') AND NOT contains(t, 'specified') AS hit
FROM (SELECT o_orderkey, lower(trim('  ' || o_orderpriority || ' ')) AS t FROM orders)""")
def clean_text(spark, sf):
    t = fc.clean_text(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("hhid"), t.alias("name"),
                                             (t.contains("low") & ~t.contains("specified")).alias("hit"))


# ---- filters ---------------------------------------------------------------

@query("f1_head_filter", "SELECT l_orderkey AS hhid, l_partkey FROM lineitem WHERE l_linenumber = 1")
def head_filter(spark, sf):
    return table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("hhid"), "l_partkey")


@query("f2_zone_filter", with_sql("SELECT hhid, zone FROM ft WHERE zone IN ('ASIA', 'EUROPE')", FT))
def zone_filter(spark, sf):
    return panel.features(spark, sf).where(F.col("zone").isin("ASIA", "EUROPE")).select("hhid", "zone")


@query("f3_known_zone", with_sql(
    "SELECT hhid, z.zone FROM c JOIN z ON z.n_nationkey = CAST(round_even(code, 0) AS BIGINT)", _X3_SQL))
def known_zone(spark, sf):
    return zone_of_code(spark, sf).where(F.col("zone").isNotNull())


_ANSWERS = ["head_age", "rooms", "household_size", *panel.CODES]


@query("f4_complete_cases", with_sql(f"""
SELECT wave, count(*) AS n_complete, (SELECT count(*) FROM ft) - CAST(sum(count(*)) OVER () AS BIGINT) AS n_dropped
FROM ft WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _ANSWERS)} GROUP BY wave""", FT))
def complete_cases(spark, sf):
    missing = F.array(*[F.col(c).isNull() for c in _ANSWERS])
    waves = panel.features(spark, sf).groupBy("wave").agg(
        F.count_if(~F.array_contains(missing, True)).alias("n_complete"), F.count(F.lit(1)).alias("_rows"))
    dropped = F.sum(F.col("_rows") - F.col("n_complete")).over(Window.partitionBy())  # one row per wave
    return waves.withColumn("n_dropped", dropped).where("n_complete > 0").drop("_rows")


@query("f5_threshold_report", with_sql("""
SELECT wave, zone, n, n < 2 * lo AS below_cap, uneven FROM (
  SELECT *, min(n) OVER (PARTITION BY wave) AS lo, min(n) OVER (PARTITION BY wave) <> max(n) OVER (PARTITION BY wave)
  AS uneven FROM (SELECT wave, zone, count(*) AS n FROM ft GROUP BY ALL))""", FT))
def threshold_report(spark, sf):
    counts = panel.features(spark, sf).groupBy("wave", "zone").agg(F.count(F.lit(1)).alias("n"))
    limits = counts.groupBy("wave").agg(F.min("n").alias("lo"), (F.count_distinct("n") > 1).alias("uneven"))
    return counts.join(limits, "wave").select("wave", "zone", "n", (F.col("n") < 2 * F.col("lo")).alias("below_cap"),
                                              "uneven")


# ---- joins -----------------------------------------------------------------

@query("j1_household_size", with_sql("""
SELECT hh.hhid, household_size FROM hh LEFT JOIN
(SELECT l_orderkey AS hhid, count(*) AS household_size FROM lineitem GROUP BY 1) USING (hhid)""",
                                     panel.SQL_HOUSEHOLDS))
def household_size(spark, sf):
    size = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("hhid")).agg(
        F.count(F.lit(1)).alias("household_size"))
    return panel.households(spark, sf).select("hhid").join(size, "hhid", "left")


@query("j2_person_sections", with_sql("""
SELECT hhid, wave, l_quantity AS head_age, l_linestatus AS head_sex FROM hh LEFT JOIN head USING (hhid)""",
                                      f"{panel.SQL_HOUSEHOLDS},{panel.SQL_HEADS}"))
def person_sections(spark, sf):
    head = panel.heads(spark, sf).withColumnRenamed("l_orderkey", "hhid")
    return panel.households(spark, sf).join(head, "hhid", "left").select(
        "hhid", "wave", F.col("l_quantity").alias("head_age"), F.col("l_linestatus").alias("head_sex"))


@query("j3_housing_section", with_sql("SELECT hhid, floor_material, rooms FROM ft", FT))
def housing_section(spark, sf):
    return panel.features(spark, sf).select("hhid", "floor_material", "rooms")


_NO_HEAD = "SELECT DISTINCT l_orderkey AS hhid FROM lineitem EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1"


@query("j4_no_head", _NO_HEAD)
def no_head(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hhid"), "l_linenumber")
    return line.select("hhid").distinct().join(line.where("l_linenumber = 1").select("hhid").distinct(),
                                               "hhid", "left_anti")


@query("j5_rows_in_set", f"""
SELECT l_orderkey AS hhid, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey IN ({_NO_HEAD})""")
def rows_in_set(spark, sf):
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hhid"), "l_partkey", "l_linenumber")
    return line.join(no_head(spark, sf), "hhid", "left_semi")


@query("j6_conform_zones", with_sql("""
SELECT r_name AS zone, r_regionkey AS zone_rank, count(hhid) AS n
FROM region LEFT JOIN (SELECT * FROM ft WHERE household_size IS NULL AND zone <> 'ASIA') f ON r_name = f.zone
GROUP BY ALL""", FT))
def conform_zones(spark, sf):
    empty = panel.features(spark, sf).where("household_size is null and zone <> 'ASIA'").groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"))
    return zones.conform(zones.zone_list(panel.zones(spark, sf)), empty, fill={"n": 0}).orderBy("zone_rank")


_WIDE = ", ".join(f"round(max(CASE WHEN wave = {w} THEN importance END), 6) + 0.0 AS w{w}" for w in panel.WAVES)


@query("j7_align_waves", with_sql(f"""
SELECT feature, {_WIDE} FROM ov WHERE NOT (feature = 'rooms' AND wave <= 2) GROUP BY feature""", IMP))
def align_waves(spark, sf):
    known = overall(spark, sf).where("not (feature = 'rooms' and wave <= 2)")
    wide = drift.feature_by_wave(known, panel.WAVES)
    return wide.select("feature", *[r6(F.col(f"w{w}")).alias(f"w{w}") for w in panel.WAVES])


@query("j8_align_versions", with_sql("""
SELECT a.zone, a.feature, round(a.v - b.v, 6) + 0.0 AS diff
FROM (SELECT zone, feature, avg(importance) AS v FROM byf WHERE wave <= 3 GROUP BY ALL) a
JOIN (SELECT zone, feature, avg(importance) AS v FROM byf WHERE wave > 3 AND feature <> 'rooms' GROUP BY ALL) b
  ON a.zone = b.zone AND a.feature = b.feature""", IMP))
def align_versions(spark, sf):
    rows = importance(spark, sf)

    def version(condition, name):
        return rows.where(condition).groupBy("zone", "feature").agg(F.avg("importance").alias(name))

    return version("wave <= 3", "a").join(version("wave > 3 and feature <> 'rooms'", "b"), ["zone", "feature"]).select(
        "zone", "feature", r6(F.col("a") - F.col("b")).alias("diff"))


# ---- aggregations ----------------------------------------------------------

@query("a1_rows_per_group", "SELECT l_orderkey AS hhid, count(*) AS n FROM lineitem GROUP BY 1")
def rows_per_group(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("hhid")).agg(F.count(F.lit(1)).alias("n"))


@query("a2_zone_means", with_sql("""
SELECT wave, zone, round(avg(head_age), 6) + 0.0 AS head_age, round(avg(rooms), 6) + 0.0 AS rooms,
       round(avg(household_size), 6) + 0.0 AS household_size FROM ft GROUP BY ALL""", FT))
def zone_feature_means(spark, sf):
    return panel.features(spark, sf).groupBy("wave", "zone").agg(*[r6(F.avg(c)).alias(c) for c in panel.NUMERIC])


@query("a3_sum_dummies", with_sql(
    "SELECT hhid, feature, round(importance, 6) + 0.0 AS importance FROM byf", IMP))
def sum_dummies(spark, sf):
    summed = by_feature_long(panel.linear_attribution(spark, sf), FEATURES, ["hhid"])
    return summed.select("hhid", "feature", r6(F.col("importance")).alias("importance"))


@query("a4_value_counts", with_sql("""
SELECT electricity_source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share
FROM ft GROUP BY 1""", FT))
def value_counts(spark, sf):
    return drift.value_counts(panel.features(spark, sf), "electricity_source").withColumn("share", r6(F.col("share")))


@query("a7_mean_of_means", with_sql("SELECT wave, feature, round(importance, 6) + 0.0 AS importance FROM ov", IMP))
def mean_of_means(spark, sf):
    return overall(spark, sf).select("wave", "feature", r6(F.col("importance")).alias("importance"))


@query("a8_best_wave", with_sql("SELECT feature, round(max(importance), 6) + 0.0 AS best FROM ov GROUP BY 1", IMP))
def best_wave(spark, sf):
    return drift.best_wave(overall(spark, sf)).select("feature", r6(F.col("best")).alias("best"))


_GAPS = " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in _ANSWERS)


@query("a9_missing_cells", with_sql(f"""
SELECT count(*) AS n_rows, CAST({len(_ANSWERS)} AS BIGINT) AS n_columns, CAST(sum({_GAPS}) AS BIGINT) AS missing_cells,
       count(*) FILTER (({_GAPS}) = 0) AS complete_rows FROM ft""", FT))
def missing_cells(spark, sf):
    return encode.missing_cells(panel.features(spark, sf), _ANSWERS)


@query("a10_any_value", with_sql("""
SELECT wave, bool_or(electricity_source IS NOT NULL) AS electricity, bool_or(household_size IS NULL) AS empty
FROM ft GROUP BY wave""", FT))
def any_value(spark, sf):
    return panel.features(spark, sf).groupBy("wave").agg(
        F.max(F.col("electricity_source").isNotNull()).alias("electricity"),
        F.bool_or(F.col("household_size").isNull()).alias("empty"))


@query("a11_distinct_classes", with_sql("""
SELECT wave, count(DISTINCT electricity_source) AS n_classes FROM ft GROUP BY wave""", FT))
def distinct_classes(spark, sf):
    return panel.features(spark, sf).groupBy("wave").agg(F.count_distinct("electricity_source").alias("n_classes"))


@query("a12_deviation", with_sql("""
SELECT feature, round(max(abs(importance - m)), 6) + 0.0 AS max_dev, round(avg(abs(importance - m)), 6) + 0.0 AS mean_dev
FROM byf JOIN (SELECT feature, avg(importance) AS m FROM byf GROUP BY 1) USING (feature) GROUP BY feature""", IMP))
def deviation(spark, sf):
    rows = importance(spark, sf)
    # One row per feature of the registry.
    centre = F.broadcast(rows.groupBy("feature").agg(F.avg("importance").alias("m")))
    dev = F.abs(F.col("importance") - F.col("m"))
    return rows.join(centre, "feature").groupBy("feature").agg(
        r6(F.max(dev)).alias("max_dev"), r6(F.avg(dev)).alias("mean_dev"))


@query("a13_spread_band", with_sql("""
SELECT wave, feature, round(m, 6) + 0.0 AS mean, round(s, 6) + 0.0 AS std, round(m - s, 6) + 0.0 AS lower,
       round(m + s, 6) + 0.0 AS upper FROM (
  SELECT wave, feature, avg(importance) AS m, stddev_samp(importance) AS s FROM byf
  WHERE feature IN ('electricity_source', 'rural_urban') GROUP BY ALL)""", IMP))
def spread_band(spark, sf):
    band = drift.spread_band(importance(spark, sf), spec.HIGHLIGHT_FEATURES)
    return band.select("wave", "feature", *[r6(F.col(c)).alias(c) for c in ("mean", "std", "lower", "upper")])


# ---- windows, samples, sorts -----------------------------------------------

@query("w1_head_row", with_sql("SELECT * FROM head", panel.SQL_HEADS))
def head_row(spark, sf):
    return panel.heads(spark, sf).withColumnRenamed("l_orderkey", "hhid")


@query("w2_stratified_sample", with_sql(f"""
SELECT hhid, zone FROM (SELECT hhid, zone, row_number() OVER (PARTITION BY zone ORDER BY {sql_key('hhid', 42)}, hhid)
  AS rn FROM ft {KNOWN}) WHERE rn <= 30""", FT))
def stratified_sample(spark, sf):
    return sampling.sample_per_group(panel.features(spark, sf).select("hhid", "zone"), "hhid", "zone", 30, 42,
                                     fc.arithmetic_key)


_ZT6 = "(SELECT wave, zone, feature, round(mean_importance, 6) + 0.0 AS mean_importance, n_households FROM zt)"


def zone_table_rounded(spark, sf):
    return zone_table(spark, sf).withColumn("mean_importance", r6(F.col("mean_importance")))


@query("w3_top_features", with_sql(f"""
SELECT wave, zone, feature, mean_importance, n_households, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY wave, zone ORDER BY mean_importance DESC, feature) AS rank FROM {_ZT6})
WHERE rank <= 5""", IMP))
def top_features(spark, sf):
    return drift.top_features(zone_table_rounded(spark, sf), 5)


_OV6 = "(SELECT wave, feature, round(importance, 6) + 0.0 AS importance FROM ov)"


def overall_rounded(spark, sf):
    return overall(spark, sf).withColumn("importance", r6(F.col("importance")))


@query("w4_first_last", with_sql(f"""
SELECT feature, min(wave) AS first_wave, arg_min(importance, wave) AS first_value, max(wave) AS last_wave,
       arg_max(importance, wave) AS last_value FROM {_OV6} WHERE NOT (feature = 'rooms' AND wave IN (1, 5))
GROUP BY feature""", IMP))
def first_last(spark, sf):
    gaps = overall_rounded(spark, sf).withColumn("importance", F.when(
        ~((F.col("feature") == "rooms") & F.col("wave").isin(1, 5)), F.col("importance")))
    return drift.first_last_value(gaps)


@query("w5_random_rows", with_sql(f"""
SELECT hhid, wave FROM hh ORDER BY {sql_key('hhid', 0)}, hhid LIMIT 25""", panel.SQL_HOUSEHOLDS))
def random_rows(spark, sf):
    return sampling.sample_rows(panel.households(spark, sf).select("hhid", "wave"), "hhid", 25, 0, fc.arithmetic_key)


@query("w6_run_numbers", with_sql("""
SELECT wave AS seed, count(*) AS n, row_number() OVER (ORDER BY wave) AS run FROM hh GROUP BY wave""",
                                  panel.SQL_HOUSEHOLDS))
def run_numbers(spark, sf):
    runs = panel.households(spark, sf).groupBy(F.col("wave").alias("seed")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.run_numbers(runs)


_RANKS = f"""(SELECT feature, best, CAST(row_number() OVER (ORDER BY best DESC, feature) AS INTEGER) AS position
  FROM (SELECT feature, max(importance) AS best FROM {_OV6} GROUP BY 1))"""


@query("o1_order_by_best", with_sql(f"SELECT * FROM {_RANKS} ORDER BY position", IMP))
def order_by_best(spark, sf):
    return drift.feature_ranks(drift.best_wave(overall_rounded(spark, sf)), "best").orderBy("position")


@query("o2_order_columns", with_sql("""
SELECT feature, mean, CAST(row_number() OVER (ORDER BY mean DESC, feature) AS INTEGER) AS position FROM (
  SELECT feature, round(avg(importance), 6) + 0.0 AS mean FROM ov GROUP BY 1)""", IMP))
def order_columns(spark, sf):
    means = overall(spark, sf).groupBy("feature").agg(r6(F.avg("importance")).alias("mean"))
    return drift.feature_ranks(means, "mean")


@query("o3_top_n", with_sql(f"SELECT wave, feature, importance FROM {_OV6} ORDER BY importance DESC, wave, feature LIMIT 6",
                            IMP))
def top_n(spark, sf):
    return overall_rounded(spark, sf).orderBy(F.desc("importance"), "wave", "feature").limit(6)


@query("o4_top_and_kept", with_sql(f"""
SELECT *, feature IN ('electricity_source', 'rural_urban') AS highlighted FROM {_RANKS}
WHERE position <= 3 OR feature IN ('electricity_source', 'rural_urban')""", IMP))
def top_and_kept(spark, sf):
    return drift.top_and_kept(order_by_best(spark, sf), 3)


# ---- set operations and reshapes -------------------------------------------

@query("u1_append", f"""
SELECT l_orderkey AS hhid, l_partkey, false AS fallback FROM lineitem WHERE l_linenumber = 1
UNION ALL SELECT l_orderkey, l_partkey, true FROM lineitem WHERE l_orderkey IN ({_NO_HEAD})""")
def append(spark, sf):
    head = head_filter(spark, sf).withColumn("fallback", F.lit(False))
    rest = rows_in_set(spark, sf).select(F.lit(True).alias("fallback"), "l_partkey", "hhid")
    return head.unionByName(rest)


@query("u2_key_difference", "SELECT o_orderkey AS hhid FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def key_difference(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("hhid")).exceptAll(
        table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("hhid")).distinct())


@query("u3_key_intersection", """
SELECT c_nationkey AS region FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def key_intersection(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("region")).intersect(
        table(spark, sf, "supplier").select("s_nationkey"))


@query("r1_one_hot", with_sql("SELECT * EXCLUDE (wave, zone, head_age, rooms, household_size) FROM x", panel.SQL_DESIGN))
def one_hot(spark, sf):
    ft = panel.features(spark, sf)
    return encode.design_matrix(ft, ["hhid"], [], encode.categories(ft, list(panel.CODES)))


@query("r2_wide_to_long", with_sql("""
SELECT hhid, feature, value FROM (SELECT hhid, head_age, rooms, CAST(household_size AS DOUBLE) AS household_size FROM ft)
UNPIVOT INCLUDE NULLS (value FOR feature IN (head_age, rooms, household_size))""", FT))
def wide_to_long(spark, sf):
    return panel.features(spark, sf).select("hhid", "head_age", "rooms", F.col("household_size").cast("double")).unpivot(
        ["hhid"], panel.NUMERIC, "feature", "value")


_GRID = ", ".join(f"max(CASE WHEN rank = {i} THEN feature END) AS rank_{i}" for i in range(1, 6))


@query("r3_rank_grid", with_sql(f"""
SELECT wave, zone, {_GRID} FROM (
  SELECT *, row_number() OVER (PARTITION BY wave, zone ORDER BY mean_importance DESC, feature) AS rank FROM {_ZT6})
GROUP BY wave, zone""", IMP))
def rank_grid(spark, sf):
    return drift.top_feature_grid(top_features(spark, sf), 5)


@query("r5_design_matrix", with_sql("SELECT * FROM x", panel.SQL_DESIGN))
def design_matrix(spark, sf):
    return panel.design(spark, sf)
