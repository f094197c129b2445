"""Every registered query: equal to its SQL twin, or at least rows with sane values."""

import pytest

import __spark_entry__ as entry_points
from panelspark import spec
from panelspark.operators import explain
from panelspark.operators.ensemble import fit_stack
from panelspark.plans import experiment
from panelspark.plans.queries_models import document_design, quick_stacking, scored_documents
from panelspark.runtime import cut_lineage
from tests.oracle import compare, duck

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    compare(name, QUERIES[name](spark, sf), con, ORACLES[name])


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "mean_importance" in df.columns


@pytest.fixture(scope="module")
def design(spark, sf):
    """The documents that the model queries see. Probes are tested with small learners; the queries fit them at full size."""
    return document_design(spark, sf)


def quick(*learners):
    return spec.Settings(cluster=spec.ClusterSettings(n_init=2), stacking=quick_stacking(learners, cv=2),
                         experiment=spec.ExperimentSettings(seeds=(42, 43)))


def test_experiment_reaches_its_own_label(design):
    tables = experiment.run_experiment(design, quick("glm", "gbm", "drf"))
    rows = {r["metric"]: r["mean"] for r in tables["aggregate"].collect()}
    assert rows["accuracy"] > 0.9 and rows["auc_macro"] > 0.9
    assert -1 <= rows["silhouette"] <= 1 and abs(rows["train_test_gap"]) < 0.1
    assert {r["run"] for r in tables["summary"].select("run").distinct().collect()} == {1, 2}


def test_random_label_is_chance(design):
    rows = experiment.random_label_probe(design, quick("glm", "xgb"), (42,)).collect()
    assert all(0.25 < r["accuracy"] < 0.75 for r in rows)


def test_gap_probe_covers_both_inputs(design):
    rows = {r["input"]: r for r in experiment.gap_probe(design, quick("glm", "drf"), (42,)).collect()}
    assert set(rows) == {"raw", "reduced"} and rows["reduced"]["test_accuracy"] > 0.9


def test_fold_probe(design):
    rows = experiment.fold_probe(design, quick("glm", "gbm"), k=3).collect()
    assert {r["fold"] for r in rows} == {0, 1, 2} and min(r["value"] for r in rows if r["metric"] == "accuracy") > 0.8


def test_fit_on_all_rows(design):
    prepared, model = experiment.fit_full(design, quick("glm", "nn"))
    right = model.transform(prepared.table).selectExpr("avg(double(prediction = cluster_label)) as share").first()
    assert right["share"] > 0.9


def test_model_attribution_adds_up(spark, sf):
    rows, columns = scored_documents(spark, sf)
    model = fit_stack(rows.where("quality is not null"), "doc_id", columns, "quality", quick_stacking(cv=2), 42, 2)
    background = explain.summarise_background(rows, columns, 20)
    picked = cut_lineage(rows.where("doc_id % 20 = 0"))
    phi, base = explain.kernel_shap(picked, ["doc_id"], columns, background, model.score(1), 500)
    score = {r["doc_id"]: r["probability"][1] for r in model.transform(picked).collect()}
    found = {r["doc_id"]: sum(r[c] for c in columns) for r in phi.collect()}
    assert found.keys() == score.keys() and max(abs(found[d] + base - score[d]) for d in score) < 1e-6


def test_background_is_observed_values(spark, sf):
    rows = QUERIES["e1_background_summary"](spark, sf).collect()
    assert abs(sum(r["weight"] for r in rows) - 1) < 1e-9
    assert {r["lang_1"] for r in rows} <= {0.0, 1.0}


def test_household_impute_leaves_no_gap(spark, sf):
    df = QUERIES["m2_household_impute"](spark, sf)
    row = df.selectExpr(*[f"count_if({c} is null) as {c}" for c in df.columns if c not in ("zone",)]).first()
    assert sum(row) == 0
    total = df.selectExpr("max(abs(electricity_source_1 + electricity_source_2 + electricity_source_3"
                          " + electricity_source_4 + electricity_source_5 - 1))").first()[0]
    assert total < 1e-9


@pytest.mark.parametrize("name", ["m8_choose_k", "m22_stacking"])
def test_returns_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
