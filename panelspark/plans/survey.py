"""Jobs over survey waves on disk: evaluate, explain, compare, verify.

Every job writes result tables under one folder, one partition per wave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark import spec
from panelspark.operators import assemble, drift, explain, quality, sampling, zones
from panelspark.plans import experiment
from panelspark.runtime import cut_lineage
from panelspark.sources import results


def _tagged(df: DataFrame, wave: int) -> DataFrame:
    return df.select(F.lit(wave).alias("wave"), *[c for c in df.columns if c != "wave"])


def household_table(spark: SparkSession, root: str, wave: int, settings: spec.Settings) -> DataFrame:
    """The assembled wave, read and joined once."""
    return cut_lineage(assemble.load_wave(spark, root, wave, settings.data.head_of_household_only))


def evaluate_wave(spark: SparkSession, root: str, wave: int, settings: spec.Settings, out: str,
                  truth: DataFrame | None = None) -> dict[str, DataFrame]:
    """Seeded evaluation of one wave: summary, aggregate, confusion, per-class and settings tables."""
    design = experiment.build_design(household_table(spark, root, wave, settings), truth=truth,
                                     truth_col=settings.experiment.true_label_col,
                                     drop_missing=settings.data.dropna_before_impute)
    tables = experiment.run_experiment(design, settings)
    tables["settings"] = spec.settings_table(spark, settings)
    tables = {name: _tagged(df, wave) for name, df in tables.items()}
    results.write_tables(tables, f"{out}/evaluation")
    return tables


def explain_households(households: DataFrame, zone_dim: DataFrame, settings: spec.Settings, key: str = "hhid",
                       zone_col: str | None = None) -> dict[str, DataFrame]:
    """Fit once on all households, explain a sample per zone, and roll up by zone.

    `zone_dim` is `(region_code, zone, zone_rank)`; pass `zone_col` if the
    households already carry their zone.
    """
    a = settings.attribution
    if zone_col is None:
        zoned = zones.attach_zone(households, zone_dim, "region").drop("zone_rank")
    else:
        zoned = households.withColumn("zone", F.col(zone_col))
    design = experiment.build_design(zoned, key, keep=["zone"], drop_missing=settings.data.dropna_before_impute)
    prepared, model = experiment.fit_full(design, settings, a.seed)
    columns = list(design.columns)
    rows = prepared.table
    picked = rows.where(F.col("zone").isNotNull()) if a.full else sampling.sample_per_group(
        rows, key, "zone", a.per_zone_sample, a.seed)
    picked = cut_lineage(picked.select(key, "zone", *columns))
    background = explain.summarise_background(rows, columns, a.background_size, a.seed)
    score = model.score(a.explain_class)
    phi, base = explain.kernel_shap(picked, [key, "zone"], columns, background, score, a.nsamples, a.seed)
    phi = cut_lineage(phi)
    by_feature = explain.by_feature(phi, columns, spec.feature_names(), [key, "zone"])
    listed = zones.zone_list(zone_dim)
    # Stored with the display rank, so that readers can list zones in order.
    zone_means = drift.zone_means(by_feature, by=["zone"]).join(listed, "zone", "left")
    scored = score(picked.withColumn("_x", F.array(*[F.col(f"`{c}`") for c in columns])), "_x").select(
        key, "zone", F.lit(base).alias("base"), "score")
    n_explained = picked.count()
    run = {"seed": a.seed, "mode": "full" if a.full else "sampled", "per_zone_sample": a.per_zone_sample,
           "background_size": a.background_size, "include_islands": a.include_islands,
           "explain_class": a.explain_class, "n_explained": n_explained, "expected_value": base}
    return {
        "attribution": explain.to_long(phi, [key, "zone"], columns), "by_feature": by_feature, "scores": scored,
        "zone_x_feature": zone_means, "zone_x_feature_no_geo": drift.without_features(zone_means),
        "zone_sample_sizes": zones.zone_counts(rows, picked, listed),
        "cluster_sizes": drift.value_counts(rows, "cluster_label"),
        "run_config": spec.settings_table(households.sparkSession, run),
    }


def explain_wave(spark: SparkSession, root: str, wave: int, settings: spec.Settings, out: str) -> dict[str, DataFrame]:
    """Explain one wave and write its tables."""
    dim = spec.zone_table(spark, settings.attribution.include_islands)
    tables = explain_households(household_table(spark, root, wave, settings), dim, settings)
    tables = {name: _tagged(df, wave) for name, df in tables.items()}
    results.write_tables(tables, f"{out}/explanation")
    return tables


def compare_waves(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Drift tables of all waves that have been explained, with and without geography."""
    tables = {}
    for name, source in (("feature_x_wave", "zone_x_feature"), ("feature_x_wave_no_geo", "zone_x_feature_no_geo")):
        zone_table = results.read_table(spark, f"{out}/explanation", source)
        waves = sorted(r["wave"] for r in results.available_waves(zone_table).collect())
        tables[name] = drift.drift_table(drift.overall(zone_table), waves)
        if name == "feature_x_wave":
            explained = results.read_table(spark, f"{out}/explanation", "scores")
            tables["households_per_zone"] = drift.zone_counts_by_wave(explained, waves)
    results.write_tables(tables, f"{out}/comparison")
    return tables


def _sample_limits(run_config: DataFrame, cap: int | None) -> DataFrame:
    """`(wave, cap)` from the stored settings of every run; NULL where all households were to be explained."""
    asked = run_config.where("setting in ('mode', 'per_zone_sample')").groupBy("wave").agg(
        F.max(F.when(F.col("setting") == "mode", F.col("value"))).alias("mode"),
        F.max(F.when(F.col("setting") == "per_zone_sample", F.col("value"))).cast("bigint").alias("cap"))
    limit = F.col("cap") if cap is None else F.lit(cap).cast("bigint")
    return asked.select("wave", F.when(F.col("mode") == "sampled", limit).alias("cap"))


def verify_results(spark: SparkSession, out: str, cap: int | None = None) -> DataFrame:
    """PASS/FAIL rows `(wave, check, status, detail)` over the stored explanation tables.

    The sample per zone is held against the stored settings of each run, or `cap`
    if given; the household counts stored in both zone tables against the sample.
    """
    def read(name):
        return results.read_table(spark, f"{out}/explanation", name)

    gaps = quality.reaggregation(read("zone_x_feature"), read("by_feature"))
    adds = _additivity(read("attribution"), read("scores"))
    sizes = read("zone_sample_sizes").where("n_total > 0")
    counts = quality.sample_targets(sizes, _sample_limits(read("run_config"), cap))
    bare = quality.forbidden_features(read("zone_x_feature_no_geo"), spec.GEO_FEATURES)
    stored = [quality.check(quality.stored_households(read(name), sizes), f"n_households:{name}", F.col("n_wrong") > 0,
                            F.col("n_wrong")) for name in ("zone_x_feature", "zone_x_feature_no_geo")]
    return quality.report(
        quality.check(gaps, "reaggregation", F.col("max_diff") > 1e-9, F.col("max_diff")),
        quality.check(adds, "additivity", F.col("max_dev") > 1e-2, F.col("max_dev")),
        quality.check(counts, "sample_cap", F.col("n_off") > 0, F.col("least")),
        quality.check(counts, "even_counts", F.col("uneven"), F.col("least")),
        quality.check(bare, "no_geo", F.col("n_forbidden") > 0, F.col("n_forbidden")), *stored).orderBy("wave", "check")


def _additivity(attribution: DataFrame, scores: DataFrame) -> DataFrame:
    """Additivity with households identified by wave and id."""
    tag = F.concat_ws("/", F.col("wave").cast("string"), F.col("hhid").cast("string"))
    return quality.additivity(attribution.withColumn("hhid", tag).drop("wave"), scores.withColumn("hhid", tag))


def probe_leakage(spark: SparkSession, root: str, wave: int, settings: spec.Settings,
                  seeds: Sequence[int] = (42, 43, 44)) -> dict[str, DataFrame]:
    """The four diagnostics of one wave: input gaps, refitted folds, random label."""
    design = experiment.build_design(household_table(spark, root, wave, settings))
    return {"gap": experiment.gap_probe(design, settings, seeds),
            "folds": experiment.fold_probe(design, settings),
            "random_label": experiment.random_label_probe(design, settings, seeds)}
