"""Seeded experiments: split, impute, reduce, cluster, stack, score."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators import cluster, metrics, reduce, sampling
from panelspark.operators.encode import categories, complete_cases, design_matrix
from panelspark.operators.ensemble import StackedModel, fit_stack
from panelspark.operators.impute import knn_impute
from panelspark.runtime import bounded_rows, cut_lineage
from panelspark.spec import Settings, feature_names

#: Runs (seeds, folds) whose jobs are in Spark's hands at the same time.
RUNS_AT_ONCE = 5


def _side_by_side(run: Callable, items: Sequence) -> list:
    """Results of independent runs, in order; their small jobs fill each other's gaps."""
    with ThreadPoolExecutor(RUNS_AT_ONCE) as pool:
        return list(pool.map(run, items))


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass(frozen=True)
class Design:
    """A design matrix with its key, columns and the columns of each question."""

    table: DataFrame
    key: str
    columns: tuple[str, ...]
    groups: Mapping[str, Sequence[str]]
    truth: str | None = None


def build_design(households: DataFrame, key: str = "hhid", keep: Sequence[str] = (), truth: DataFrame | None = None,
                 truth_col: str | None = None, drop_missing: bool = False) -> Design:
    """Encode a household table; an outside label is joined by key and never becomes a feature."""
    kinds = {k: [n for n in feature_names(k) if n in households.columns and n != truth_col]
             for k in ("numeric", "categorical")}
    cats = categories(households, kinds["categorical"])
    groups = {f: [f"{f}_{c}" for c in codes] for f, codes in cats.items() if codes}
    columns = [*kinds["numeric"], *[c for g in groups.values() for c in g]]
    table = design_matrix(households, [key, *keep], kinds["numeric"], cats)
    if drop_missing:
        table = complete_cases(table, columns)
    if truth is not None:
        table = table.join(truth.select(key, truth_col), key)
    return Design(table, key, tuple(columns), groups, truth_col if truth is not None else None)


@dataclass(frozen=True)
class Prepared:
    """Rows with imputed columns, coordinates and `cluster_label`; fitted on the rows not in `is_test`."""

    table: DataFrame
    reducer: reduce.Reducer
    clusters: cluster.Clusters


def prepare(design: Design, rows: DataFrame, settings: Settings, seed: int) -> Prepared:
    """Impute, reduce and label all rows with everything fitted on the training rows."""
    train = ~F.col("is_test")
    s = settings
    filled = rows
    if s.impute.enabled:
        filled = knn_impute(rows, design.key, list(design.columns), design.groups, donors=rows.where(train),
                            k=s.impute.n_neighbors, weights=s.impute.weights)
    filled = cut_lineage(filled)
    reducer = reduce.fit_reducer(filled.where(train), list(design.columns), s.reduction.method,
                                 s.reduction.n_components, s.reduction.standardize)
    placed = reducer.transform(filled)
    k = s.cluster.n_clusters
    if s.cluster.auto_select_k:
        k, _ = cluster.choose_k(placed.where(train), reducer.outputs, s.cluster.k_search_range, s.cluster.n_init, seed,
                                s.cluster.exact_silhouette)
    clusters = cluster.fit_kmeans(placed.where(train), reducer.outputs, k, s.cluster.n_init, seed,
                                  by_norm=s.cluster.order_labels_by_norm)
    return Prepared(cut_lineage(clusters.assign(placed, "cluster_label")), reducer, clusters)


def cluster_quality(table: DataFrame, columns: Sequence[str], label: str = "cluster_label",
                    exact: bool = True) -> DataFrame:
    """The three validity indices as one row.

    The exact silhouette compares all distinct points; with `exact=False` the
    linear squared-Euclidean one takes its place under its own name.
    """
    silhouette = (cluster.silhouette(table, columns, label).scalar().alias("silhouette") if exact else
                  F.lit(cluster.squared_silhouette(table, columns, label)).alias("silhouette_squared"))
    return table.sparkSession.range(1).select(
        silhouette,
        cluster.calinski_harabasz(table, columns, label).scalar().alias("calinski_harabasz"),
        cluster.davies_bouldin(table, columns, label).scalar().alias("davies_bouldin"))


def classifier_columns(design: Design, prepared: Prepared, settings: Settings) -> list[str]:
    """The classifier sees the imputed answers, or the coordinates the label was drawn from."""
    return prepared.reducer.outputs if settings.stacking.classifier_input == "reduced" else list(design.columns)


@dataclass(frozen=True)
class SeedResult:
    metrics: DataFrame
    confusion: DataFrame
    per_class: DataFrame
    scored: DataFrame
    model: StackedModel
    prepared: Prepared


def _long(row: DataFrame) -> DataFrame:
    return row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot(
        [], row.columns, "metric", "value")


def score(scored: DataFrame, truth: str, n_classes: int) -> DataFrame:
    """All test metrics and the train/test gap as `(metric, value)` rows."""
    test = scored.where("is_test")
    cells = metrics.confusion(test, truth, "prediction")
    with_scores = test.withColumns({f"_s{k}": F.col("probability")[k] for k in range(n_classes)})
    auc = metrics.macro_auc(with_scores, truth, {k: f"_s{k}" for k in range(n_classes)})
    gap = metrics.train_test_gap(scored, truth, "prediction").drop("test_accuracy")
    return _long(metrics.macro_metrics(cells)).unionByName(_long(auc)).unionByName(_long(gap))


def classes(table: DataFrame, truth: str, limit: int = 1000) -> list:
    """The values of an outside label in order; a missing one is an error."""
    rows = bounded_rows(table.select(truth).distinct().orderBy(truth), limit, f"The label {truth}")
    if any(r[0] is None for r in rows):
        raise ValueError(f"The label {truth} is missing for some households.")
    return [r[0] for r in rows]


def _named(df: DataFrame, names: list) -> DataFrame:
    """Class numbers in `truth`, `predicted` and `label` replaced by the classes they stand for."""
    values = F.array(*map(F.lit, names))
    return df.withColumns({c: values[F.col(c).cast("int")] for c in ("truth", "predicted", "label") if c in df.columns})


def run_seed(design: Design, settings: Settings, seed: int, quality: bool = True) -> SeedResult:
    """One full run. The target is the outside label if there is one, else the cluster label."""
    rows = sampling.split(design.table, design.key, seed, settings.experiment.test_size, stratify=design.truth)
    prepared = prepare(design, cut_lineage(rows), settings, seed)
    target, names, table = "cluster_label", None, prepared.table
    if design.truth:
        target, names = "_class", classes(design.table, design.truth)
        table = table.withColumn("_class", (F.array_position(F.array(*map(F.lit, names)), F.col(design.truth)) - 1).cast("int"))
    model = fit_stack(table.where("not is_test"), design.key, classifier_columns(design, prepared, settings), target,
                      settings.stacking, seed)
    scored = cut_lineage(model.transform(table).select(design.key, "is_test", F.col(target).cast("int").alias("truth"),
                                                       "prediction", "probability"))
    values = score(scored, "truth", model.n_classes)
    if quality and len(prepared.clusters.centers) > 1:
        values = values.unionByName(_long(cluster_quality(
            table.where("not is_test"), prepared.reducer.outputs, exact=settings.cluster.exact_silhouette)))
    cells = metrics.confusion(scored.where("is_test"), "truth", "prediction")
    per_class = metrics.per_class(cells)
    if names:
        cells, per_class = (_named(df, names) for df in (cells, per_class))
    tag = F.lit(seed).alias("seed")
    described = [tag, F.lit(design.truth or "cluster_label").alias("target"), F.lit(len(prepared.clusters.centers)).alias("k")]
    return SeedResult(cut_lineage(values.select(*described, "metric", "value")), cells.select(tag, "*"),
                      per_class.select(tag, "*"), scored, model, prepared)


def run_experiment(design: Design, settings: Settings, quality: bool = True) -> dict[str, DataFrame]:
    """Every seed; tables `summary`, `aggregate`, `confusion`, `per_class`."""
    tables: dict[str, DataFrame] = {}
    results = _side_by_side(lambda seed: run_seed(design, settings, seed, quality), settings.experiment.seeds)
    for number, result in enumerate(results, 1):
        for name, part in (("summary", result.metrics), ("confusion", result.confusion),
                           ("per_class", result.per_class)):
            part = part.select(F.lit(number).alias("run"), "*")
            tables[name] = part if name not in tables else tables[name].unionByName(part)
    tables["aggregate"] = metrics.aggregate_runs(tables["summary"])
    return tables


# ---- diagnostics -----------------------------------------------------------

def gap_probe(design: Design, settings: Settings, seeds: Sequence[int]) -> DataFrame:
    """Train and test accuracy with answers and with coordinates as input, per seed."""
    prepared = dict(zip(seeds, _side_by_side(lambda seed: prepare(design, cut_lineage(
        sampling.split(design.table, design.key, seed, settings.experiment.test_size)), settings, seed), seeds)))

    def one(run):
        seed, kind = run
        s = replace(settings, stacking=replace(settings.stacking, classifier_input=kind))
        table = prepared[seed].table
        model = fit_stack(table.where("not is_test"), design.key, classifier_columns(design, prepared[seed], s), "cluster_label",
                          s.stacking, seed)
        gap = metrics.train_test_gap(model.transform(table), "cluster_label", "prediction")
        return gap.select(F.lit(seed).alias("seed"), F.lit(kind).alias("input"), "*")

    return _stacked(_side_by_side(one, [(seed, kind) for seed in seeds for kind in ("raw", "reduced")]))


def fold_probe(design: Design, settings: Settings, k: int = 5, seed: int = 42) -> DataFrame:
    """Accuracy and AUC per fold, with the cluster label refitted on each fold's training rows."""
    whole = prepare(design, design.table.withColumn("is_test", F.lit(False)), settings, seed)
    strata = whole.table.select(design.key, F.col("cluster_label").alias("_stratum"))
    placed = cut_lineage(sampling.folds(design.table.join(strata, design.key), design.key, seed, k, stratify="_stratum"))

    def one(fold):
        rows = placed.withColumn("is_test", F.col("fold") == fold).drop("_stratum", "fold")
        prepared = prepare(design, rows, settings, seed)
        model = fit_stack(prepared.table.where("not is_test"), design.key,
                          classifier_columns(design, prepared, settings), "cluster_label", settings.stacking, seed)
        test = cut_lineage(model.transform(prepared.table).where("is_test").select("cluster_label", "prediction",
                                                                                   "probability"))
        auc = metrics.macro_auc(test.withColumns({f"_s{c}": F.col("probability")[c] for c in range(model.n_classes)}),
                                "cluster_label", {c: f"_s{c}" for c in range(model.n_classes)})
        return _long(metrics.accuracy(test, "cluster_label", "prediction")).unionByName(_long(auc)).select(
            F.lit(fold).alias("fold"), "metric", "value")

    return _stacked(_side_by_side(one, range(k)))


def random_label_probe(design: Design, settings: Settings, seeds: Sequence[int],
                       key_fn=sampling.hashed_key) -> DataFrame:
    """Test accuracy on a label that only depends on the id: about one half."""
    def one(seed):
        labelled = design.table.withColumn("random_label", sampling.random_label(F.col(design.key), 1000 + seed, key_fn))
        rows = cut_lineage(sampling.split(labelled, design.key, seed, settings.experiment.test_size))
        prepared = prepare(design, rows, settings, seed)
        model = fit_stack(prepared.table.where("not is_test"), design.key, list(design.columns), "random_label",
                          settings.stacking, seed)
        return metrics.accuracy(model.transform(prepared.table).where("is_test"), "random_label", "prediction").select(
            F.lit(seed).alias("seed"), "accuracy")

    return _stacked(_side_by_side(one, seeds))


def fit_full(design: Design, settings: Settings, seed: int = 42) -> tuple[Prepared, StackedModel]:
    """One fit on all rows of a wave, on the answers themselves, for explanation."""
    if settings.stacking.classifier_input != "raw":
        raise ValueError("Attribution explains survey answers: set classifier_input to 'raw'.")
    prepared = prepare(design, design.table.withColumn("is_test", F.lit(False)), settings, seed)
    model = fit_stack(prepared.table, design.key, list(design.columns), "cluster_label", settings.stacking, seed)
    return prepared, model
