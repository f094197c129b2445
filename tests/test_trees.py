"""Shared-pass trees: passes equal single tasks, layouts do not matter, quality matches Spark's learners."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from panelspark.operators import trees
from panelspark.operators.trees import TreeSpec


def sample(spark, n, seed=1, width=5, noise=0.15, classes=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)), 3)
    x[:, -1] = rng.integers(0, 3, n)
    signal = x[:, 0] + x[:, 1] * x[:, 2] + (x[:, -1] == 1)
    y = np.digitize(signal, np.quantile(signal, np.arange(1, classes) / classes))
    flip = rng.random(n) < noise
    y[flip] = rng.integers(0, classes, flip.sum())
    return spark.createDataFrame([(i, [float(v) for v in r], int(c), i % 5) for i, (r, c) in enumerate(zip(x, y))],
                                 "id long, x array<double>, label int, fold int")


def arrays(model):
    return [model.feature.tolist(), model.bin.tolist(), model.left.tolist(), np.round(model.value, 9).tolist()]


def specs(forest_trees=3, depth=30):
    return [TreeSpec("boost", 6, 3, fold=0), TreeSpec("boost", 4, 4, l2=1.0), TreeSpec("boost", 7, 2, fold=3),
            TreeSpec("forest", forest_trees, depth, fold=1), TreeSpec("forest", forest_trees, depth)]


def canonical(model, i=0):
    """A tree as nested tuples, so that the numbering of nodes does not count."""
    def walk(n):
        if model.left[n] == n:
            return tuple(np.round(model.value[n], 9))
        return int(model.feature[n]), int(model.bin[n]), walk(model.left[n]), walk(model.left[n] + 1)

    return [walk(r) for r in model.roots]


@pytest.fixture(scope="module")
def small_table(spark):
    return trees.tree_table(sample(spark, 900), "id", "label", "fold", "x", 5, 2)


def test_passes_equal_single_tasks(small_table, monkeypatch):
    near = trees.fit_trees(small_table, specs())
    monkeypatch.setattr(trees, "SNAPSHOT", 3)
    monkeypatch.setattr(trees, "LOCAL_CELLS", 900)  # nodes of at most 180 rows are finished by tasks
    far = trees.fit_trees(small_table, specs())
    assert [canonical(m) for m in near] == [canonical(m) for m in far]


def test_layout_does_not_matter(spark, small_table):
    again = trees.tree_table(sample(spark, 900).repartition(11), "id", "label", "fold", "x", 5, 2)
    one, two = (trees.fit_trees(t, specs()) for t in (small_table, again))
    assert [arrays(m) for m in one] == [arrays(m) for m in two]


def test_held_out_fold_is_not_seen(spark, small_table):
    changed = sample(spark, 900).withColumn("label", F.when(F.col("fold") == 0, 1 - F.col("label")).otherwise(F.col("label")))
    other = trees.tree_table(changed, "id", "label", "fold", "x", 5, 2)
    spec = [TreeSpec("boost", 5, 3, fold=0), TreeSpec("forest", 2, 8, fold=0)]
    assert [arrays(m) for m in trees.fit_trees(small_table, spec)] == [arrays(m) for m in trees.fit_trees(other, spec)]


def _held_out(spark, model_fn, n=4000):
    train, test = sample(spark, n, 1), sample(spark, n, 2)
    table = trees.tree_table(train, "id", "label", "fold", "x", 5, 2)
    rows = test.orderBy("id").collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
    ours = trees.class_scores(trees.fit_trees(table, [model_fn]), trees.to_bins(x, table.cuts), 2)[:, 1]
    return train, test, y, ours


def _spark_scores(learner, train, test):
    vectors = [d.withColumn("features", array_to_vector("x")) for d in (train, test)]
    scored = learner.setLabelCol("label").fit(vectors[0]).transform(vectors[1])
    return np.array([r.p for r in scored.orderBy("id").select(vector_to_array("probability")[1].alias("p")).collect()])


def test_boosting_is_as_good_as_spark(spark):
    """Held-out accuracy within two points, probabilities 0.06 apart on average."""
    train, test, y, ours = _held_out(spark, TreeSpec("boost", 40, 3))
    theirs = _spark_scores(GBTClassifier(maxIter=40, maxDepth=3, stepSize=0.1, seed=1), train, test)
    assert ((ours > 0.5) == y).mean() >= ((theirs > 0.5) == y).mean() - 0.02
    assert np.abs(ours - theirs).mean() < 0.06


def test_forest_is_as_good_as_spark(spark):
    train, test, y, ours = _held_out(spark, TreeSpec("forest", 40, 30))
    theirs = _spark_scores(RandomForestClassifier(numTrees=40, maxDepth=30, featureSubsetStrategy="sqrt", seed=1), train, test)
    assert ((ours > 0.5) == y).mean() >= ((theirs > 0.5) == y).mean() - 0.01
    assert np.abs(ours - theirs).mean() < 0.06


def test_three_classes_and_single_class(spark):
    table = trees.tree_table(sample(spark, 600, classes=3), "id", "label", "fold", "x", 5, 3)
    boosters = trees.fit_trees(table, [TreeSpec("boost", 20, 3, target=k) for k in range(3)])
    forest = trees.fit_trees(table, [TreeSpec("forest", 20, 12)])
    rows = sample(spark, 600, 2, classes=3).collect()
    bins = trees.to_bins(np.array([r.x for r in rows]), table.cuts)
    for models in (boosters, forest):
        p = trees.class_scores(models, bins, 3)
        assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == [r.label for r in rows]).mean() > 0.6
    same = sample(spark, 50).withColumn("label", F.lit(1))
    table = trees.tree_table(same, "id", "label", "fold", "x", 5, 2)
    for spec in (TreeSpec("boost", 3, 3), TreeSpec("forest", 3, 3)):
        assert (trees.class_scores(trees.fit_trees(table, [spec]), bins[:5], 2)[:, 1] > 0.9).all()


def test_bootstrap_weights_are_poisson():
    w = trees.bootstrap(np.arange(200_000), TreeSpec("forest", 1, 1), 0)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    other = trees.bootstrap(np.arange(200_000), TreeSpec("forest", 1, 1), 1)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01


def test_equal_rows_are_grown_once(spark, monkeypatch):
    """Copies of rows cost no more than their counts, by single tasks and by passes, and weigh as often as they come."""
    few = sample(spark, 60)
    many = few.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("id", F.col("id") * 100 + F.col("copy"))
    one, all_ = (trees.tree_table(d, "id", "label", "fold", "x", 5, 2) for d in (few, many))
    assert all_.groups.count() == one.groups.count() and all_.groups.agg(F.sum("_n")).first()[0] == 2400
    boost = [TreeSpec("boost", 5, 3), TreeSpec("boost", 4, 4, fold=2)]
    assert all_.cells(boost[0]) == one.cells(boost[0])
    near = [canonical(m) for m in trees.fit_trees(all_, boost)]
    assert near == [canonical(m) for m in trees.fit_trees(one, boost)]  # splits and steps depend on shares alone
    monkeypatch.setattr(trees, "LOCAL_CELLS", 0)
    assert near == [canonical(m) for m in trees.fit_trees(all_, boost)]


def test_collapsed_rows_and_drawn_weights():
    rng = np.random.default_rng(3)
    for width in (1, 5, 8, 9, 64):
        bins = rng.integers(0, 3, (500, width)).astype(np.uint8)
        bins[250:] = bins[:250]
        kept, at = trees.collapsed(bins)
        assert (kept[at] == bins).all() and len(kept) == len({r.tobytes() for r in bins})
    spec, ids = TreeSpec("forest", 1, 1, fold=3), rng.integers(-2**62, 2**62, 50_000)
    u = (trees._mix(spec.seed, 3, 7, ids) >> np.uint64(11)).astype(float) / 2.0**53
    assert (trees.bootstrap(ids, spec, 7) == np.searchsorted(trees._POISSON, u, side="right")).all()


def test_tree_tasks_run_side_by_side(small_table, monkeypatch):
    """The tasks of one call are one job: read as they are made, they would run one after the other."""
    seen = []
    monkeypatch.setattr(trees, "cut_lineage", lambda df, cut=trees.cut_lineage: (seen.append(df.columns), cut(df))[1])
    trees.fit_trees(small_table, [TreeSpec("forest", 3, 8)])
    assert ["unit", "tree", "path", "feature", "bin", "left", "value"] in seen


def test_stack_bins_and_walks_equal_rows_once(monkeypatch):
    from panelspark.operators import ensemble

    rng, cuts = np.random.default_rng(5), [np.array([-0.5, 0.5]), np.array([0.0])]
    tree = trees.Tree(np.array([0, 0, 0], np.int32), np.array([1, 255, 255], np.uint8), np.array([1, 1, 2]), np.array([[0.0], [-0.4], [0.7]]))
    forest = trees.Tree(tree.feature, tree.bin, tree.left, np.array([[0.5, 0.5], [0.9, 0.1], [0.2, 0.8]]))
    learners = [ensemble.TreeLearner((trees.TreeModel.of(TreeSpec(kind, 1, 1), cuts, 0.1, [t]),), 2) for kind, t in (("boost", tree), ("forest", forest))]
    x, binned, walked = rng.normal(size=(300, 2)), [], []
    wanted = np.concatenate([b.probabilities(x)[:, [1]] for b in learners], axis=1)
    monkeypatch.setattr(trees, "to_bins", lambda x, c, f=trees.to_bins: (binned.append(len(x)), f(x, c))[1])
    monkeypatch.setattr(trees, "class_scores", lambda m, b, n, f=trees.class_scores: (walked.append(len(b)), f(m, b, n))[1])
    assert (ensemble._meta_rows(learners, x, 2, False) == wanted).all()
    assert binned == [300] and max(walked) <= 6
