"""Queries over attribution, zone importance and drift."""

from __future__ import annotations


from pyspark.sql import functions as F

from panelspark import spec
from panelspark.operators import assemble, drift, explain, zones
from panelspark.plans import panel
from panelspark.plans.panel import table, with_sql
from panelspark.plans.queries_checks import _explained
from panelspark.plans.queries_relational import (
    FEATURES, IMP, importance, overall, overall_rounded, r6, zone_table, zone_table_rounded)
from panelspark.plans.registry import query

FT = panel.SQL_FEATURES

# ---- Shapley values of a closed-form score ---------------------------------

_PRICE = ["l_quantity", "l_discount", "l_tax"]


def price_score(c):
    return c["l_quantity"] * 0.02 + c["l_discount"] * 5.0 + c["l_quantity"] * c["l_discount"] * 0.3 - c["l_tax"] * 2.0


def _price_heads(spark, sf):
    return assemble.head_rows(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", panel.MEMBER_ORDER,
                              [*_PRICE, "l_linestatus"], size_name=None).withColumnRenamed("l_orderkey", "hhid")


def _price_background(heads):
    """One mean row per line status, weighted by its share."""
    means = heads.groupBy("l_linestatus").agg(*[F.avg(c).alias(c) for c in _PRICE], F.count(F.lit(1)).alias("n"))
    return explain.background_of(means.orderBy("l_linestatus"), _PRICE, "n", 10)


def _sql_coalition(q, d, t):
    return f"({q} * 0.02 + {d} * 5.0 + {q} * {d} * 0.3 - {t} * 2.0)"


def _sql_value(members):
    return "sum(w * {}) AS v{}".format(
        _sql_coalition(*[f"h.{c}" if i in members else f"b.{c}" for i, c in enumerate("qdt")]),
        "".join(str(i) for i in sorted(members)))


_SUBSETS = [(), (0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2)]
_SQL_PRICE = f"""
h AS (SELECT l_orderkey AS hhid, l_quantity AS q, l_discount AS d, l_tax AS t, l_linestatus FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END,
               {', '.join(panel.MEMBER_ORDER)}) AS rn FROM lineitem) WHERE rn = 1),
b AS (SELECT avg(q) AS q, avg(d) AS d, avg(t) AS t, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM h) AS w
      FROM h GROUP BY l_linestatus),
v AS (SELECT hhid, {', '.join(_sql_value(s) for s in _SUBSETS)} FROM h, b GROUP BY hhid)"""


def _sql_phi(j):
    weights = {0: "1 / 3.0", 1: "1 / 6.0", 2: "1 / 3.0"}
    terms = []
    for s in _SUBSETS:
        if j not in s:
            with_j = "".join(str(i) for i in sorted((*s, j)))
            terms.append(f"{weights[len(s)]} * (v{with_j} - v{''.join(map(str, s))})")
    return " + ".join(terms)


_SQL_SHAPLEY = " UNION ALL ".join(
    f"SELECT hhid, '{c}' AS \"column\", round({_sql_phi(j)}, 6) + 0.0 AS phi FROM v" for j, c in enumerate(_PRICE))


@query("e4_exact_shapley", with_sql(_SQL_SHAPLEY, _SQL_PRICE))
def exact_shapley(spark, sf):
    heads = _price_heads(spark, sf)
    phi = explain.exact_shapley(heads, ["hhid"], _PRICE, _price_background(heads), price_score)
    return explain.to_long(phi, ["hhid"], _PRICE).withColumn("phi", r6(F.col("phi")))


@query("e3_kernel_shap", with_sql(_SQL_SHAPLEY, _SQL_PRICE))
def kernel_shap(spark, sf):
    heads = _price_heads(spark, sf)
    phi, _ = explain.kernel_shap(heads, ["hhid"], _PRICE, _price_background(heads),
                                 explain.expression_score(_PRICE, price_score))
    return explain.to_long(phi, ["hhid"], _PRICE).withColumn("phi", r6(F.col("phi")))


@query("j10_coalition_values", with_sql("""
SELECT hhid, s, round(CASE s WHEN 0 THEN v0 WHEN 1 THEN v12 WHEN 2 THEN v012 END, 6) + 0.0 AS v
FROM v, (VALUES (0), (1), (2)) k(s)""", _SQL_PRICE))
def coalition_values(spark, sf):
    import numpy as np

    heads = _price_heads(spark, sf)
    masks = np.array([[1, 0, 0], [0, 1, 1], [1, 1, 1]], dtype=bool)
    rows = heads.select("hhid", F.array(*_PRICE).alias("x"))
    return explain.coalition_values(rows, ["hhid"], "x", _price_background(heads), masks, explain.expression_score(
        _PRICE, price_score)).withColumn("v", r6(F.col("v")))


# ---- roll-ups --------------------------------------------------------------

@query("e5_feature_importance", with_sql(
    "SELECT hhid, wave, zone, feature, round(importance, 6) + 0.0 AS importance FROM byf", IMP))
def feature_importance(spark, sf):
    return importance(spark, sf).withColumn("importance", r6(F.col("importance")))


@query("e6_zone_feature_means", with_sql("""
SELECT zone, r_regionkey AS zone_rank, wave, feature, round(mean_importance, 6) + 0.0 AS mean_importance, n_households
FROM zt JOIN region ON r_name = zone""", IMP))
def zone_feature_means(spark, sf):
    listed = zones.zone_list(panel.zones(spark, sf))
    return zones.conform(listed, zone_table_rounded(spark, sf)).orderBy("wave", "zone_rank", "feature")


@query("e7_no_geography", with_sql("""
SELECT wave, zone, feature, round(mean_importance, 6) + 0.0 AS mean_importance, n_households
FROM zt WHERE feature NOT IN ('region', 'rural_urban')""", IMP))
def no_geography(spark, sf):
    return drift.without_features(zone_table_rounded(spark, sf))


@query("e8_zone_counts", with_sql("""
SELECT r_name AS zone, r_regionkey AS zone_rank, coalesce(n_total, 0) AS n_total, coalesce(n_explained, 0) AS n_explained
FROM region LEFT JOIN (SELECT zone, count(*) AS n_total FROM ft GROUP BY 1) a ON a.zone = r_name
LEFT JOIN (SELECT zone, CAST(sum(n) AS BIGINT) AS n_explained FROM (
  SELECT wave, zone, least(count(*), 30) AS n FROM ft WHERE zone IS NOT NULL GROUP BY ALL) GROUP BY 1) b ON b.zone = r_name""",
                                 FT))
def zone_counts(spark, sf):
    return zones.zone_counts(panel.features(spark, sf), _explained(spark, sf),
                             zones.zone_list(panel.zones(spark, sf)))


_WIDE = ", ".join(f"max(CASE WHEN wave = {w} THEN importance END) AS w{w}" for w in panel.WAVES)
_OV6 = "(SELECT wave, feature, round(importance, 6) + 0.0 AS importance FROM ov)"


@query("e9_drift_table", with_sql(f"""
SELECT *, CAST(row_number() OVER (ORDER BY best DESC, feature) AS INTEGER) AS position FROM (
  SELECT feature, {_WIDE}, max(importance) AS best FROM {_OV6} GROUP BY feature)""", IMP))
def drift_table(spark, sf):
    return drift.drift_table(overall_rounded(spark, sf), panel.WAVES)


@query("e10_zone_counts_by_wave", with_sql(f"""
SELECT zone, {', '.join(f'count(*) FILTER (wave = {w}) AS w{w}' for w in panel.WAVES)} FROM ft
WHERE zone IS NOT NULL GROUP BY zone""", FT))
def zone_counts_by_wave(spark, sf):
    return drift.zone_counts_by_wave(panel.features(spark, sf), panel.WAVES)


@query("e11_convergence", with_sql("""
SELECT wave, round(e, 6) + 0.0 AS electricity_source, round(r, 6) + 0.0 AS rural_urban, round(abs(e - r), 6) + 0.0 AS gap
FROM (SELECT wave, max(importance) FILTER (feature = 'electricity_source') AS e,
             max(importance) FILTER (feature = 'rural_urban') AS r FROM ov GROUP BY wave)""", IMP))
def convergence(spark, sf):
    pair = drift.convergence(overall(spark, sf), "electricity_source", "rural_urban")
    return pair.select("wave", *[r6(F.col(c)).alias(c) for c in ("electricity_source", "rural_urban", "gap")])


@query("e12_distribution", with_sql("""
SELECT hhid, wave, zone, feature, round(importance, 6) + 0.0 AS importance FROM byf WHERE feature IN (
  SELECT feature FROM (SELECT feature, round(avg(importance), 6) AS m FROM ov GROUP BY 1) ORDER BY m DESC, feature LIMIT 6)""",
                                   IMP))
def distribution(spark, sf):
    rows = importance(spark, sf)
    means = drift.overall(drift.zone_means(rows)).groupBy("feature").agg(r6(F.avg("importance")).alias("m"))
    return drift.distribution(rows, drift.feature_ranks(means, "m"), 6).withColumn("importance", r6(F.col("importance")))


_PICKED = ["ASIA", "EUROPE"]


@query("e13_zone_summary", with_sql(f"""
SELECT zone, r_regionkey AS zone_rank, n_total, n_explained, {', '.join(
    f'max(CASE WHEN rank = {i} THEN feature END) AS rank_{i}' for i in range(1, 6))} FROM (
  SELECT zone, feature, row_number() OVER (PARTITION BY zone ORDER BY m DESC, feature) AS rank FROM (
    SELECT zone, feature, round(avg(mean_importance), 6) AS m FROM zt WHERE feature NOT IN ('region', 'rural_urban')
    GROUP BY ALL)) JOIN region ON r_name = zone
  JOIN (SELECT zone, count(*) AS n_total, count(household_size) AS n_explained FROM ft GROUP BY zone) USING (zone)
WHERE zone IN ('ASIA', 'EUROPE') GROUP BY zone, r_regionkey, n_total, n_explained""", IMP))
def zone_summary(spark, sf):
    ft = panel.features(spark, sf)
    counts = zones.zone_counts(ft, ft.where("household_size is not null"), zones.zone_list(panel.zones(spark, sf)))
    means = drift.without_features(zone_table(spark, sf)).groupBy("zone", "feature").agg(
        r6(F.avg("mean_importance")).alias("mean_importance"))
    return drift.zone_summary(means, counts, _PICKED)


# ---- attribution of fitted models ------------------------------------------

def _document_score(spark, sf):
    """The full stack for document quality, fitted on the labelled documents, with all documents and their features."""
    from panelspark.operators.ensemble import fit_stack
    from panelspark.plans.queries_models import scored_documents

    rows, columns = scored_documents(spark, sf)
    model = fit_stack(rows.where("quality is not null"), "doc_id", columns, "quality", spec.StackingSettings(), 42, 2)
    return rows, columns, model


@query("e1_background_summary")
def background_summary(spark, sf):
    from panelspark.plans.queries_models import scored_documents

    rows, columns = scored_documents(spark, sf)
    background = explain.summarise_background(rows, columns, 50)
    return background.table(spark).select("b", "weight", *[F.col("background")[i].alias(c)
                                                          for i, c in enumerate(columns)])


@query("e2_model_score")
def model_score(spark, sf):
    rows, columns, model = _document_score(spark, sf)
    scored = model.score(1)(rows.withColumn("x", F.array(*columns)), "x")
    return scored.select("doc_id", "quality", "score")


@query("e3_model_attribution")
def model_attribution(spark, sf):
    """Sampled documents of every language explained against a summarised background."""
    from panelspark.operators.sampling import sample_per_group

    rows, columns, model = _document_score(spark, sf)
    background = explain.summarise_background(rows, columns, 50)
    picked = sample_per_group(rows, "doc_id", "lang", 30, 42)
    phi, base = explain.kernel_shap(picked, ["doc_id"], columns, background, model.score(1), 500)
    return explain.to_long(phi, ["doc_id"], columns).withColumn("base", F.lit(base))


@query("e3_vector_attribution")
def vector_attribution(spark, sf):
    """Cluster membership of vectors explained at the full budget: 500 coalitions, 50 background rows."""
    from panelspark.operators import cluster
    from panelspark.operators.ensemble import fit_stack
    from panelspark.operators.sampling import sample_per_group
    from panelspark.plans.queries_models import VECTOR, _coordinates, vectors
    from panelspark.runtime import cut_lineage

    points, outputs = _coordinates(spark, sf)
    labels = cluster.fit_kmeans(points, outputs, 2).assign(points, "cluster").select("vec_id", "cluster")
    rows = cut_lineage(vectors(spark, sf).join(labels, "vec_id"))
    model = fit_stack(rows, "vec_id", VECTOR, "cluster", spec.StackingSettings(), 42, 2)
    background = explain.summarise_background(rows, VECTOR, 50)
    picked = sample_per_group(rows, "vec_id", "label", 21, 42)
    phi, base = explain.kernel_shap(picked, ["vec_id"], VECTOR, background, model.score(1), 500)
    return phi.withColumn("base", F.lit(base))
