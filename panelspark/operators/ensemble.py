"""Base learners and the stacked ensemble.

Trees of all folds and of the refit grow together (see `trees`); the linear model
and the network are Spark's, fitted side by side. A fitted learner is a small
step over blocks of rows, so a whole stack scores in one pass, and so do the
held-out rows of all folds: each row picks the learners of its own fold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.operators import trees
from panelspark.operators.encode import vector_column
from panelspark.operators.sampling import folds
from panelspark.runtime import cut_lineage, fit_partitions
from panelspark.spec import StackingSettings

TREE_LEARNERS = ("gbm", "drf", "xgb")
LEARNERS = ("glm", "nn", *TREE_LEARNERS)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LinearLearner:
    weights: np.ndarray
    intercepts: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights.T + self.intercepts
        return _softmax(np.concatenate([np.zeros((len(z), 1)), z], axis=1) if z.shape[1] == 1 else z)


@dataclass(frozen=True)
class NetworkLearner:
    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        for i, (weights, bias) in enumerate(self.layers):
            x = x @ weights.T + bias
            x = 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500))) if i < len(self.layers) - 1 else _softmax(x)
        return x


@dataclass(frozen=True)
class TreeLearner:
    models: tuple[trees.TreeModel, ...]
    n_classes: int

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(*trees.collapsed(trees.to_bins(x, self.models[0].cuts)))

    def of_bins(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of different rows of bins, and which of them each row is."""
        return trees.class_scores(self.models, bins, self.n_classes)[at]


def probability_column(values: Column, score: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Class probabilities of rows of numbers, as `array<double>`, block by block."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def scored(rows: pd.Series) -> pd.Series:
        return pd.Series(list(score(np.stack(rows))) if len(rows) else [], dtype=object)

    return scored(values)


def tree_specs(name: str, s: StackingSettings, seed: int, fold: int | None, n_classes: int) -> list[trees.TreeSpec]:
    """The models of a tree learner: one, or one per class for boosting beyond two classes."""
    if name == "drf":
        return [trees.TreeSpec("forest", s.drf_trees, s.drf_depth, fold, seed=seed)]
    count, depth, l2 = (s.gbm_trees, s.gbm_depth, 0.0) if name == "gbm" else (s.xgb_trees, s.xgb_depth, 1.0)
    return [trees.TreeSpec("boost", count, depth, fold, k, s.learning_rate, l2, seed) for k in ([1] if n_classes == 2 else range(n_classes))]


def _fit_spark(name: str, rows: DataFrame, label: str, s: StackingSettings, seed: int, n_rows: int, width: int, n_classes: int):
    """A linear model or a network on a `_vector` column."""
    if name == "glm":
        # The penalty matches an L2 weight of 1 on the summed loss.
        model = LogisticRegression(maxIter=s.glm_iterations, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False,
                                   labelCol=label, featuresCol="_vector").fit(rows)
        return LinearLearner(model.coefficientMatrix.toArray(), model.interceptVector.toArray())
    sizes = [width, *s.hidden_layers, n_classes]
    model = MultilayerPerceptronClassifier(layers=sizes, maxIter=s.nn_epochs, seed=seed, labelCol=label, featuresCol="_vector").fit(rows)
    flat, layers, at = model.weights.toArray(), [], 0
    for a, b in zip(sizes, sizes[1:]):  # per layer the weights column by column, then the bias
        layers.append((flat[at:at + a * b].reshape(a, b).T.copy(), flat[at + a * b:at + a * b + b].copy()))
        at += a * b + b
    return NetworkLearner(tuple(layers))


def laid_out(df: DataFrame, key: str, width: int) -> tuple[DataFrame, int]:
    """The rows in a layout that follows from key, row count and width alone, and their count."""
    rows = cut_lineage(df)
    n = rows.count()
    return cut_lineage(rows.repartition(fit_partitions(n, width), key).sortWithinPartitions(key)), n


def fit_learners(data: DataFrame, key: str, label: str, names: Sequence[str], s: StackingSettings, seed: int, n_rows: int, width: int,
                 n_classes: int, held: Sequence[int | None] = (None,), threads: int = 4) -> dict[tuple[int | None, str], object]:
    """Every named learner once per held-out fold (None: on all rows), from `features` (array of doubles) and `fold`."""
    unknown = set(names) - set(LEARNERS)
    if unknown:
        raise ValueError(f"Unknown learner {sorted(unknown)[0]!r}.")
    vectors = data.select(F.col(label).cast("double").alias(label), "fold", array_to_vector("features").alias("_vector")).cache()

    def plain(task):
        fold, name = task
        rows = vectors if fold is None else vectors.where(F.col("fold") != fold)
        n = n_rows if fold is None else n_rows * (s.cv - 1) // s.cv
        return _fit_spark(name, rows, label, s, seed, n, width, n_classes)

    def grown():
        wanted = [(f, n) for f in held for n in names if n in TREE_LEARNERS]
        if not wanted:
            return {}
        table = trees.tree_table(data, key, label, "fold", "features", width, n_classes)
        each = {t: tree_specs(t[1], s, seed, t[0], n_classes) for t in wanted}
        models = iter(trees.fit_trees(table, [x for part in each.values() for x in part]))
        return {t: TreeLearner(tuple(next(models) for _ in part), n_classes) for t, part in each.items()}

    tasks = [(f, n) for f in held for n in names if n not in TREE_LEARNERS]
    try:
        with ThreadPoolExecutor(threads + 1) as pool:
            forest = pool.submit(grown)
            fitted = dict(zip(tasks, pool.map(plain, tasks)))
            return fitted | forest.result()
    finally:
        vectors.unpersist()


def fit_learner(df: DataFrame, key: str, label: str, name: str, s: StackingSettings, seed: int, width: int, n_classes: int):
    """One learner on all rows of `features` (array of doubles)."""
    data, n = laid_out(df.select(key, label, "features", F.lit(0).alias("fold")), key, width)
    return fit_learners(data, key, label, [name], s, seed, n, width, n_classes)[None, name]


@dataclass(frozen=True)
class StackedModel:
    columns: tuple[str, ...]
    bases: tuple
    meta: object
    n_classes: int
    passthrough: bool

    def score(self, explain_class: int = 1):
        """A scoring step for attribution: adds `score`, the probability of one class."""
        return lambda df, values: self.transform_values(df, values).withColumn(
            "score", F.col("probability")[explain_class]).drop("probability", "prediction")

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `probability` (one entry per class) and `prediction`."""
        return self.transform_values(df.withColumn("_values", vector_column(self.columns)), "_values").drop("_values")

    def transform_values(self, df: DataFrame, values: str) -> DataFrame:
        """The same from one `array<double>` column in column order, in one pass."""
        bases, meta, n, through = self.bases, self.meta, self.n_classes, self.passthrough
        score = lambda x: meta.probabilities(_meta_rows(bases, x, n, through))
        out = df.withColumn("probability", probability_column(F.col(values), score))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))


def _meta_rows(bases: Sequence, x: np.ndarray, n_classes: int, passthrough: bool) -> np.ndarray:
    """Binary problems give one probability per learner, others one per class."""
    kept = [1] if n_classes == 2 else list(range(n_classes))
    binned: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # learners of one table share its cuts

    def probabilities(base) -> np.ndarray:
        if not isinstance(base, TreeLearner):
            return base.probabilities(x)
        cuts = base.models[0].cuts
        if id(cuts) not in binned:
            binned[id(cuts)] = trees.collapsed(trees.to_bins(x, cuts))
        return base.of_bins(*binned[id(cuts)])

    parts = [probabilities(b)[:, kept] for b in bases]
    return np.concatenate(parts + [x] * passthrough, axis=1)


def out_of_fold(data: DataFrame, fitted: dict, names: Sequence[str], n_classes: int, passthrough: bool = False) -> DataFrame:
    """`data` with `_meta`: what learners that never saw a row say about it; one pass over all folds."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def held_out(rows: pd.Series, fold: pd.Series) -> pd.Series:
        out = np.empty(len(rows), object)
        for f in fold.unique():
            at = np.flatnonzero(fold == f)
            out[at] = list(_meta_rows([fitted[int(f), n] for n in names], np.stack(rows.iloc[at]), n_classes, passthrough))
        return pd.Series(out)

    return data.withColumn("_meta", held_out("features", "fold"))


def fit_stack(df: DataFrame, key: str, columns: Sequence[str], label: str, s: StackingSettings, seed: int = 42,
              n_classes: int | None = None, threads: int = 4) -> StackedModel:
    """Out-of-fold stacking: meta learner on held-out probabilities, base learners refitted on all rows."""
    if s.meta_learner not in ("glm", "gbm"):
        raise ValueError(f"Unknown meta learner {s.meta_learner!r}.")
    rows = df.select(key, F.col(label).cast("int").alias(label), vector_column(columns))
    data, n_rows = laid_out(folds(rows, key, seed, s.cv, stratify=label), key, len(columns))
    if n_classes is None:
        n_classes = int(data.agg(F.max(label)).first()[0]) + 1
    names = s.base_learners
    fitted = fit_learners(data, key, label, names, s, seed, n_rows, len(columns), n_classes, [None, *range(s.cv)], threads)
    held = {k: v for k, v in fitted.items() if k[0] is not None}
    width = len(names) * (1 if n_classes == 2 else n_classes) + (len(columns) if s.passthrough else 0)
    meta_rows = out_of_fold(data, held, names, n_classes, s.passthrough).select(
        key, label, F.col("_meta").alias("features"), F.lit(0).alias("fold"))
    meta = fit_learners(cut_lineage(meta_rows), key, label, [s.meta_learner], s, seed, n_rows, width, n_classes)[None, s.meta_learner]
    return StackedModel(tuple(columns), tuple(fitted[None, n] for n in names), meta, n_classes, s.passthrough)
