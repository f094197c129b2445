"""Edge cases on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark import spec
from panelspark.functions import columns as fc
from panelspark.operators import (
    assemble, cluster, drift, encode, ensemble, explain, harmonize, metrics, quality, reduce, sampling, zones)
from panelspark.plans.queries_models import quick_stacking
from panelspark.sources import results


def test_recode(spark):
    df = spark.createDataFrame([(None,), ("1.0",), ("3.7",), ("5",), ("abc",), ("99",), ("-2.9",)], "v string")
    got = [r[0] for r in df.select(fc.recode(F.col("v"), {1: 7, 3: 9}, text=True)).collect()]
    assert got == [None, "7", "9", "5", "abc", "99", "-2"]
    numeric = spark.createDataFrame([(1.0,), (None,), (8.9,)], "v double")
    assert [r[0] for r in numeric.select(fc.recode(F.col("v"), {1: 7})).collect()] == [7, None, 8]
    assert harmonize.harmonize(df, {}).columns == ["v"]


def test_recode_by_table_equals_recode_by_wave(spark):
    long = spark.createDataFrame([(1, "water_source", 5.0), (3, "water_source", 13.0), (5, "water_source", 5.0),
                                  (2, "rural_urban", 0.0)], "wave int, feature string, code double")
    rows = harmonize.harmonize_long(long, spec.crosswalk_table(spark)).collect()
    assert {(r["wave"], r["feature"]): r["code"] for r in rows} == {
        (1, "water_source"): 9, (3, "water_source"): 7, (5, "water_source"): 5, (2, "rural_urban"): 2}


def test_zone_rounding_and_exclusion(spark):
    codes = spark.createDataFrame([(2.5,), (3.5,), (51.0,), (None,), (999.0,)], "code double")
    dim = spec.zone_table(spark)
    got = {r["code"]: r["zone"] for r in zones.attach_zone(codes, dim, "code").collect()}
    assert got == {2.5: "Northern", 3.5: "Northern", 51.0: "Zanzibar", None: None, 999.0: None}
    bare = {r["code"]: r["zone"] for r in zones.attach_zone(codes, dim, "code", ["Zanzibar"]).collect()}
    assert bare[51.0] is None
    assert spec.zone_table(spark, False).select("zone").distinct().count() == 6
    assert [r["region_code"] for r in zones.uncovered_codes(codes, "code", dim).collect()] == [999]


def test_one_hot_keeps_missing(spark):
    df = spark.createDataFrame([(1, 1.0, "x"), (2, 2.0, "1"), (3, None, None)], "id int, a double, b string")
    cats = encode.categories(df, ["a", "b"])
    assert cats == {"a": ["1", "2"], "b": ["1", "x"]}
    rows = encode.design_matrix(df, ["id"], [], cats).orderBy("id").collect()
    assert tuple(rows[0])[1:] == (1.0, 0.0, 0.0, 1.0)
    assert tuple(rows[2])[1:] == (None,) * 4
    assert encode.dummy_names(cats, drop_first=True) == ["a_2", "b_x"]
    with pytest.raises(ValueError, match="more than 1 rows"):
        encode.categories(df, ["a"], limit=1)


def test_head_rule(spark):
    rows = [("h1", 2, 20), ("h1", 3, 30), ("h2", 1, 11), ("h2", 1, 10), ("h3", 2, 5), ("h3", 1, 9)]
    df = spark.createDataFrame(rows, "hh string, member int, age int")
    got = {r["hh"]: (r["household_size"], r["age"]) for r in
           assemble.head_rows(df, "hh", "member", ["member"], ["age"]).collect()}
    assert got == {"h1": (2, 20), "h2": (2, 10), "h3": (2, 9)}
    with pytest.raises(Exception, match="must not be null"):
        assemble.require_keys(spark.createDataFrame([(None,)], "hh string"), "hh").collect()


def test_rural_source_is_chosen_per_column(spark):
    df = spark.createDataFrame([(None, None, 1), (None, 2, 1)], "locality int, clustertype int, y4_rural int")
    assert assemble.first_usable(df, ["locality", "clustertype", "y4_rural"]) == "clustertype"
    assert assemble.first_usable(df, ["locality", "absent", None]) is None


def test_registry(spark):
    assert len(spec.feature_names()) == 18 and len(spec.feature_names("categorical")) == 15
    assert spec.feature_names("numeric") == ["head_age", "rooms", "household_size"]
    assert set(spec.features_by_section()) == {"A", "B", "C", "I"}
    assert spec.registry_table(spark).count() == 18
    flat = {r["setting"]: r["value"] for r in spec.settings_table(spark, spec.Settings()).collect()}
    assert flat["stacking.cv"] == "5" and flat["impute.n_neighbors"] == "5"
    one = spark.range(1).select(results.setting(spec.settings_table(spark, {"expected_value": 0.25}), "expected_value"))
    assert float(one.first()[0]) == 0.25


def test_macro_metrics_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, 0)], "t int, p int")
    cells = metrics.confusion(df, "t", "p")
    assert cells.count() == 9
    row = metrics.macro_metrics(cells).first()
    assert row["accuracy"] == 0.5
    assert row["precision"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert row["recall"] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert [r["label"] for r in metrics.per_class(cells).orderBy("label").collect()] == [0, 1]
    same = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")
    one = metrics.macro_metrics(metrics.confusion(same, "t", "p")).first()
    assert one["kappa"] is None and one["mcc"] == 0.0 and one["accuracy"] == 1.0


def test_auc_ties_and_empty_side(spark):
    rng = np.random.default_rng(0)
    score = rng.integers(0, 12, 400) / 7.0
    y = (rng.random(400) < 0.3 + 0.03 * score).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)], "y int, s double")
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for target in (1, 3, 50_000):
        assert metrics.rank_auc(df, "s", F.col("y") == 1, target=target).first()["auc"] == pytest.approx(want)
    assert metrics.rank_auc(df.where("y = 1"), "s", F.col("y") == 1).first()["auc"] is None


def test_auc_cuts_follow_each_group(spark):
    """One group's scores all lie between two neighbouring scores of the other."""
    rng = np.random.default_rng(1)
    wide, narrow = rng.random(4000) * 1000, 500 + rng.random(3000) * 1e-6
    y = rng.integers(0, 2, 7000)
    rows = [(g, float(s), int(v)) for (g, s), v in zip([("wide", s) for s in wide] + [(None, s) for s in narrow], y)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    counts = df.groupBy("g", "s").count()
    sizes = metrics.score_ranges(counts, "s", ["g"], 100).groupBy("g", "_r").agg(F.count("*").alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi"))
    for g, n in (("wide", 4000), (None, 3000)):
        parts = sorted(r for r in sizes.where(F.col("g").eqNullSafe(g)).select("_r", "n", "lo", "hi").collect())
        assert sum(r["n"] for r in parts) == n and max(r["n"] for r in parts) <= 200
        assert n / 100 <= len(parts) <= 2 * n / 100 + 1
        assert all(a["hi"] < b["lo"] for a, b in zip(parts, parts[1:]))
    got = {r["g"]: r["auc"] for r in metrics.rank_auc(df, "s", F.col("y") == 1, ["g"], 100).collect()}
    for g, s, v in (("wide", wide, y[:4000]), (None, narrow, y[4000:])):
        want = np.mean(s[v == 1][:, None] > s[v == 0]) + 0.5 * np.mean(s[v == 1][:, None] == s[v == 0])
        assert got[g] == pytest.approx(want)
    few = metrics.score_ranges(df.where("g is null").limit(5).select("s"), "s", [], 100)
    assert {r["_r"] for r in few.collect()} == {0}
    assert metrics.rank_auc(df.limit(0), "s", F.col("y") == 1, ["g"]).count() == 0


def test_ranked_equals_row_number(spark):
    df = spark.range(500).withColumn("g", (F.col("id") % 3 == 0).cast("int"))
    got = {r["id"]: r["draw_rank"] for r in sampling.ranked(df, "id", 7, ["g"], slices=16).collect()}
    keys = {r["id"]: (r["g"], r["k"]) for r in df.select("id", "g", fc.hashed_key(F.col("id"), 7).alias("k")).collect()}
    for g in (0, 1):
        order = sorted((i for i in keys if keys[i][0] == g), key=lambda i: (keys[i][1], i))
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    parts = sampling.split(df, "id", 1, 0.3, "g").groupBy("g", "is_test").count().collect()
    assert {(r["g"], r["is_test"]): r["count"] for r in parts} == {
        (0, True): math.ceil(333 * 0.3), (0, False): 333 - math.ceil(333 * 0.3), (1, True): 51, (1, False): 116}
    fold = sampling.folds(df.repartition(7), "id", 1, 5, "g").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in fold) == [99, 100, 100, 100, 101] or all(98 <= r["count"] <= 101 for r in fold)
    # The draw does not depend on how the rows are partitioned.
    again = {r["id"]: r["draw_rank"] for r in sampling.ranked(df.repartition(9), "id", 7, ["g"]).collect()}
    assert again == got


def test_sample_per_group_large_draw(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, "big").otherwise("small"))
    picked = sampling.sample_per_group(df, "id", "g", 1500, 3).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in picked} == {"big": 1500, "small": 1000}
    plan = sampling.sample_per_group(df, "id", "g", 30, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_scaler_and_components(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (2, 2.0, 4.0, 5.0), (3, 3.0, 6.0, 5.0)],
                               "id int, a double, b double, c double")
    z = reduce.fit_scaler(df, ["a", "b", "c"]).transform(df).orderBy("id").collect()
    assert z[0]["a"] == pytest.approx(-math.sqrt(1.5)) and z[0]["c"] == 0.0
    fitted = reduce.fit_reducer(df, ["a", "b"], "pca", 2)
    rows = fitted.transform(df).orderBy("id").collect()
    assert [r["a"] for r in rows] == [1.0, 2.0, 3.0]
    assert rows[2]["pc1"] == pytest.approx(math.sqrt(3)) and rows[2]["pc2"] == pytest.approx(0.0, abs=1e-9)
    plain = reduce.fit_reducer(df, ["a", "b"], "none")
    assert plain.outputs == ["pc1", "pc2"] and plain.transform(df).count() == 3
    with pytest.raises(ValueError):
        reduce.fit_reducer(df, ["a"], "umap")


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_silhouette_with_copies_and_singleton(spark, block_rows):
    rng = np.random.default_rng(1)
    x = np.round(np.vstack([rng.normal(-2, 1, (25, 2)), rng.normal(2, 1, (20, 2)), [[9.0, 9.0]]]), 1)
    x[5:15] = x[5]
    label = [0] * 25 + [1] * 20 + [2]
    df = spark.createDataFrame([(float(a), float(b), c) for (a, b), c in zip(x, label)], "a double, b double, c int")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    lab, scores = np.array(label), []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in set(label) if k != lab[i])
        scores.append((b - a) / max(a, b))
    assert cluster.silhouette(df, ["a", "b"], "c", block_rows).first()[0] == pytest.approx(np.mean(scores))


def test_kmeans_and_label_order(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.2, (40, 2)), rng.normal(5, 0.2, (20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")
    fitted = cluster.fit_kmeans(df, ["a", "b"], 2, n_init=2)
    assert fitted.sizes == (40, 20)
    assert [r["n"] for r in fitted.assign(df).groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()] \
        == [40, 20]
    assert cluster.order_by_column([[3.0, 0.0], [1.0, 9.0]], 0) == [1, 0]
    best, scores = cluster.choose_k(df, ["a", "b"], (1, 2, 3, 99), n_init=2)
    assert best == 2 and set(scores) == {2, 3}
    assert cluster.squared_silhouette(fitted.assign(df), ["a", "b"], "label") > 0.9


def test_owner_feature(spark):
    df = spark.createDataFrame([("a",), ("a_1",), ("a_b_1",), ("z_9",), ("ab_1",)], "c string")
    got = [r[0] for r in df.select(explain.owner_feature(F.col("c"), ["a", "a_b"])).collect()]
    assert got == ["a", "a", "a_b", "z_9", "ab_1"]
    assert explain.owned_columns(["a", "a_1", "a_b_1", "z_9", "ab_1"], ["a", "a_b"]) == {
        "a": ["a", "a_1"], "a_b": ["a_b_1"], "z_9": ["z_9"], "ab_1": ["ab_1"]}


def test_shapley_closed_form(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    background = explain.Background(((1.0, 1.0),), (1.0,))
    score = lambda c: c["a"] + 2 * c["b"] + c["a"] * c["b"]
    exact = explain.exact_shapley(df, ["id"], ["a", "b"], background, score).first()
    assert (exact["a"], exact["b"]) == (pytest.approx(3.0), pytest.approx(7.0))
    phi, base = explain.kernel_shap(df, ["id"], ["a", "b"], background, explain.expression_score(["a", "b"], score))
    assert base == 4.0
    assert [tuple(r) for r in phi.collect()] == [(1, pytest.approx(3.0), pytest.approx(7.0))]


def test_kernel_shap_sampled_and_fixed_columns(spark):
    cols = [f"x{i}" for i in range(12)]
    rng = np.random.default_rng(5)
    data = rng.normal(size=(3, 12))
    data[:, 11] = 1.0
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)],
                               "id int, " + ", ".join(f"{c} double" for c in cols))
    background = explain.Background((tuple([0.0] * 11 + [1.0]), tuple([1.0] * 12)), (0.25, 0.75))
    weights = np.arange(12) - 4.0
    score = explain.expression_score(cols, lambda c: sum((c[n] * float(w) for n, w in zip(cols, weights)), F.lit(0.0)))
    phi, base = explain.kernel_shap(df, ["id"], cols, background, score, nsamples=120)
    rows = {(r["id"], r["column"]): r["phi"] for r in explain.to_long(phi, ["id"], cols).collect()}
    assert len(rows) == 36
    # The weighted fit is exact for a linear score, whatever coalitions were drawn.
    mean = np.array([0.75] * 11 + [1.0])
    for i in range(3):
        for j, c in enumerate(cols):
            assert rows[(i, c)] == pytest.approx(weights[j] * (data[i, j] - mean[j]), abs=1e-8)


def test_kernel_shap_of_many_columns(spark):
    cols = [f"x{i}" for i in range(300)]
    rng = np.random.default_rng(6)
    masks, weights = explain.coalition_design(300, 700)
    values = rng.normal(size=300)
    solve = explain._solver(masks, weights)
    scores = masks @ values
    head = solve @ (scores - masks[:, -1] * values.sum())
    assert np.allclose(head, values[:-1], atol=1e-8)
    with pytest.raises(ValueError, match="at least 600"):
        explain.coalition_design(300, 500)
    df = spark.createDataFrame([(1, 1.0, None)], "id int, x0 double, x1 double")
    with pytest.raises(ValueError, match="x1"):
        explain.kernel_shap(df, ["id"], cols[:2], explain.Background(((0.0, 0.0),), (1.0,)), None, 10)


def test_fits_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(k)) for i, (r, k) in enumerate(zip(x, y))],
                               "id int, a double, b double, c double, y int")
    s = quick_stacking(("drf", "nn"), cv=2)
    results = []
    for parts in (3, 11):
        dealt = df.repartition(parts)
        model = ensemble.fit_stack(dealt, "id", ["a", "b", "c"], "y", s)
        scored = {r["id"]: r["probability"][1] for r in model.transform(df).collect()}
        centers = cluster.fit_kmeans(dealt, ["a", "b", "c"], 4, n_init=1).centers
        results.append((scored, centers))
    (one, c1), (two, c2) = results
    assert max(abs(one[i] - two[i]) for i in one) < 1e-6 and np.allclose(c1, c2, atol=1e-9)


@pytest.mark.parametrize("names", [[1, 2], ["a", "b", "c"]])
def test_outside_labels_of_any_value(spark, names):
    from panelspark.plans import experiment

    rng = np.random.default_rng(7)
    rows = [(f"h{i}", *map(float, rng.normal(size=2) + 5 * np.array([i % len(names), (i % len(names)) ** 2])), names[i % len(names)])
            for i in range(120)]
    table = spark.createDataFrame(rows, f"hhid string, a double, b double, label {'int' if names[0] == 1 else 'string'}")
    design = experiment.Design(table, "hhid", ("a", "b"), {}, "label")
    settings = spec.Settings(impute=spec.ImputeSettings(enabled=False), cluster=spec.ClusterSettings(n_init=1),
                             stacking=quick_stacking(("glm",), 2))
    result = experiment.run_seed(design, settings, 42, quality=False)
    rows = result.metrics.collect()
    values = {r["metric"]: r["value"] for r in rows}
    assert values["auc_macro"] > 0.9 and values["accuracy"] > 0.8
    assert {(r["target"], r["k"]) for r in rows} == {("label", 2)}
    assert {r["label"] for r in result.per_class.collect()} == set(names)
    missing = experiment.Design(table.withColumn("label", F.when(F.col("hhid") != "h0", F.col("label"))), "hhid", ("a", "b"), {}, "label")
    with pytest.raises(ValueError, match="missing"):
        experiment.classes(missing.table, "label")


def test_one_scan_per_query(spark, sf):
    from panelspark.plans import catalog

    for name, table, most in (("f4_complete_cases", "lineitem", 1), ("a4_value_counts", "lineitem", 1), ("q5_additivity", "lineitem", 2)):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert sum(f"{table}.parquet" in line and "Scan" in line for line in plan.splitlines()) <= most, name


def test_coalition_design():
    masks, weights = explain.coalition_design(5, 500)
    assert len(masks) == 30 and weights.sum() == pytest.approx(1.0)
    masks, weights = explain.coalition_design(30, 200, seed=3)
    assert 195 <= len(masks) <= 201 and weights.sum() == pytest.approx(1.0)
    again, _ = explain.coalition_design(30, 200, seed=3)
    assert (masks == again).all()
    sizes = masks.sum(axis=1)
    assert (sizes == 1).sum() == 30 and (sizes == 29).sum() == 30


def test_multiclass_stack(spark):
    rng = np.random.default_rng(4)
    centers = np.array([[0, 0], [6, 0], [0, 6]])
    x = np.vstack([rng.normal(c, 1.0, (40, 2)) for c in centers])
    y = np.repeat([0, 1, 2], 40)
    df = spark.createDataFrame([(i, float(a), float(b), int(k)) for i, ((a, b), k) in enumerate(zip(x, y))],
                               "id int, a double, b double, y int")
    s = quick_stacking(("glm", "gbm", "nn"), cv=2)
    model = ensemble.fit_stack(df, "id", ["a", "b"], "y", s)
    rows = model.transform(df).collect()
    assert np.mean([r["prediction"] == r["y"] for r in rows]) > 0.9
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in rows)
    with pytest.raises(ValueError):
        ensemble.fit_stack(df, "id", ["a", "b"], "y", spec.StackingSettings(base_learners=("svm",)))


def test_out_of_fold_covers_every_row_once(spark):
    df = spark.range(60).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"),
                                (F.col("id") % 7).cast("double").alias("a"))
    s = quick_stacking(("glm", "gbm"), cv=3)
    data = sampling.folds(df.select("id", "y", F.array("a").alias("features")), "id", 1, 3, "y")
    fitted = ensemble.fit_learners(data, "id", "y", s.base_learners, s, 1, 60, 1, 2, range(3))
    oof = ensemble.out_of_fold(data, fitted, s.base_learners, 2)
    plan = oof._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan
    rows = oof.collect()
    assert len({r["id"] for r in rows}) == len(rows) == 60
    for r in rows:
        each = [fitted[r["fold"], n].probabilities(np.array([r["features"]]))[0, 1] for n in s.base_learners]
        assert np.allclose(r["_meta"], each)
    passthrough = ensemble.fit_stack(df, "id", ["a"], "y", spec.StackingSettings(
        base_learners=("glm",), cv=2, passthrough=True, glm_iterations=20))
    assert passthrough.transform(df).count() == 60


def test_quality_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "k int, v string")
    assert quality.differing_rows(a, a.repartition(3)).count() == 0
    assert {(r["only_in"], r["k"], r["v"]) for r in quality.differing_rows(a, b).collect()} == {
        ("first", 1, "x"), ("first", 2, "y"), ("second", 2, "z")}
    now = spark.createDataFrame([(1, "m", 1.0)], "wave int, metric string, value double")
    locked = spark.createDataFrame([(1, "m", 1.1), (2, "m", 1.0)], "wave int, metric string, value double")
    ok = {r["wave"]: r["ok"] for r in quality.locked_values(now, locked, 0.2).collect()}
    assert ok == {1: True, 2: False}


def test_drift_handles_absent_features(spark):
    ov = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.1), (2, "b", 0.9)], "wave int, feature string, importance double")
    rows = drift.drift_table(ov, [1, 2]).collect()
    assert [(r["feature"], r["w1"], r["w2"], r["position"]) for r in rows] == [("b", None, 0.9, 1), ("a", 0.5, 0.1, 2)]
    ends = {r["feature"]: (r["first_wave"], r["last_value"]) for r in drift.first_last_value(ov).collect()}
    assert ends == {"a": (1, 0.1), "b": (2, 0.9)}
    label = spark.createDataFrame([(4,), (9,)], "w int").select(fc.wave_label(F.col("w"), spec.WAVE_YEARS)).collect()
    assert [r[0] for r in label] == ["W4 (2014/15)", "W9"]


def test_wave_overwrite_keeps_other_waves(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "wave int, v string")
    results.write_table(df, str(tmp_path), "t")
    results.write_table(spark.createDataFrame([(2, "c")], "wave int, v string"), str(tmp_path), "t")
    back = results.read_table(spark, str(tmp_path), "t")
    assert {(r["wave"], r["v"]) for r in back.collect()} == {(1, "a"), (2, "c")}
    assert {r["wave"] for r in results.available_waves(back).collect()} == {1, 2}


@pytest.mark.parametrize("classes", [2, 3])
def test_learners_score_like_spark(spark, classes):
    """The numpy form of Spark's linear model and network gives Spark's own probabilities."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 2))
    df = spark.createDataFrame([(i, float(a), float(b), i % classes) for i, (a, b) in enumerate(x)], "id int, a double, b double, y int")
    rows = df.select("id", F.col("y").cast("double").alias("y"), array_to_vector(F.array("a", "b")).alias("_vector")).repartition(1)
    s = quick_stacking()
    for name, learner in (("glm", LogisticRegression(maxIter=50, regParam=1 / 90, standardization=False)),
                          ("nn", MultilayerPerceptronClassifier(layers=[2, 8, classes], maxIter=20, seed=5))):
        theirs = learner.setLabelCol("y").setFeaturesCol("_vector").fit(rows).transform(rows).orderBy("id")
        want = np.array([r[0] for r in theirs.select(vector_to_array("probability")).collect()])
        ours = ensemble._fit_spark(name, rows, "y", s, 5, 90, 2, classes)
        assert np.allclose(ours.probabilities(x), want, atol=1e-6)


def test_starts_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ([0, 0], [4, 0], [0, 4])] + [np.full((500, 2), 4.0)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    passes = []
    frame = type(df)
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: (passes.append(1), collect(self))[1])
    found = cluster.fit_starts(df, ["a", "b"], [2, 4], n_init=6)
    together = len(passes)
    passes.clear()
    slowest = 0
    for k in (2, 4):
        for s in range(6):
            one = cluster.fit_starts(df, ["a", "b"], [k], n_init=1, seed=42 + s)[k][0]
            assert np.allclose(one.centers, found[k][s].centers, atol=1e-9) and one.cost == pytest.approx(found[k][s].cost)
            slowest, _ = max(slowest, len(passes)), passes.clear()
    assert together == slowest
    best = cluster.fit_kmeans(df, ["a", "b"], 4, n_init=6)
    assert sum(best.sizes) == len(x) and best.cost == pytest.approx(min(c.cost for c in found[4]))
    gaps = ((x[:, None] - np.array(best.centers)[None])**2).sum(axis=2)
    assert np.bincount(gaps.argmin(axis=1), minlength=4).tolist() == list(best.sizes)
    assert best.cost == pytest.approx(gaps.min(axis=1).sum())


def test_background_values_are_the_nearest_observed(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(400, 3)), 2)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    centers = np.array(cluster.fit_starts(df, ["a", "b", "c"], [12], 1)[12][0].centers)
    got = np.array(explain.summarise_background(df, ["a", "b", "c"], 12).rows)
    for j in range(3):
        seen = np.unique(x[:, j])
        assert np.allclose(got[:, j], seen[np.abs(seen[None] - centers[:, j, None]).argmin(axis=1)])


def test_sample_targets_and_stored_counts(spark):
    counts = spark.createDataFrame(
        [(1, "a", 50, 30), (1, "b", 9, 9), (2, "a", 50, 30), (2, "b", 40, 29), (3, "a", 7, 7), (3, "b", 90, 90), (4, "a", 5, 5)],
        "wave int, zone string, n_total long, n_explained long")
    limits = spark.createDataFrame([(1, 30), (2, 30), (3, None)], "wave int, cap long")
    got = {r["wave"]: (r["n_off"], r["uneven"]) for r in quality.sample_targets(counts, limits).collect()}
    assert got == {1: (0, False), 2: (1, True), 3: (0, False), 4: (1, False)}
    cells = spark.createDataFrame(
        [(1, "a", "x", 30), (1, "a", "y", 30), (1, "b", "x", 9), (2, "a", "x", 30), (2, "a", "y", 31), (3, "a", "x", None),
         (3, "c", "x", 1)], "wave int, zone string, feature string, n_households long")
    wrong = {r["wave"]: r["n_wrong"] for r in quality.stored_households(cells, counts.where("wave < 4")).collect()}
    assert wrong == {1: 0, 2: 2, 3: 3}


def test_silhouette_writes_no_copies_of_blocks(spark):
    """Blocks are met where they lie, each pair once; far from the origin and very near points keep their distances."""
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(120, 2)) * [1, 50] + 1e6, 4)
    x[60:64] = x[:4] + 1e-4
    c = rng.integers(0, 3, 120)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, c)], "a double, b double, c int")
    each = cluster.silhouette_points(df, ["a", "b"], "c", 16)
    assert "CartesianProduct" in each._jdf.queryExecution().toString()
    d = np.sqrt(((x[:, None] - x[None])**2).sum(axis=2))
    wanted = []
    for i in range(120):
        mean = {k: d[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in range(3)}
        a, b = mean[c[i]], min(v for k, v in mean.items() if k != c[i])
        wanted.append((b - a) / max(a, b))
    assert sorted(r["silhouette"] for r in each.collect()) == pytest.approx(sorted(wanted), abs=1e-8)
    near = cluster._distances(x, x)
    assert (np.diag(near) == 0).all() and np.abs(near - d).max() < 1e-9


def test_silhouette_block_sums_serve_both_sides():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    x, k, w = rng.normal(size=(7, 3)), np.array([0, 1, 0, 2, 1, 1, 0]), np.arange(1, 8)
    block = lambda b, at: [b, k[at].tobytes(), w[at].tobytes(), x[at].tobytes()]
    one, two = block(0, slice(0, 4)), block(1, slice(4, 7))
    rows = [[*p, *q] for p, q in ((one, one), (one, two), (two, two))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdefgh"))
    d = np.sqrt(((x[:, None] - x[None])**2).sum(axis=2)) * w
    for out, at in zip(cluster._block_sums([batch]), (slice(0, 4), slice(4, 7))):
        clusters = np.frombuffer(out.column("clusters")[0].as_py(), np.int64)
        found = np.frombuffer(out.column("sums")[0].as_py()).reshape(-1, len(clusters))
        assert np.allclose(found, np.stack([d[at][:, k == c].sum(axis=1) for c in clusters], axis=1))
