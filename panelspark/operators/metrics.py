"""Classification metrics from counts and ranks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """`(by, truth, predicted, n)` over every pair of labels seen on either side, zeros kept."""
    counts = df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    # The label set has one entry per class, so the grid is classes x classes.
    labels = counts.groupBy(*by).agg(
        F.array_union(F.collect_set("truth"), F.collect_set("predicted")).alias("_labels"))
    grid = labels.withColumn("truth", F.explode("_labels")).withColumn("predicted", F.explode("_labels")).drop("_labels")
    return grid.join(counts, [*by, "truth", "predicted"], "left").fillna({"n": 0})


def label_counts(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hits, true rows and predicted rows of each label."""
    n, hit = F.col("n"), F.col("truth") == F.col("predicted")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.when(hit, n).otherwise(0).alias("tp"), n.alias("t"),
                 F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("t"), n.alias("p")))
    return cells.select(*by, F.inline(sides)).groupBy(*by, "label").agg(
        F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))


def _scores() -> dict[str, Column]:
    tp, t, p = (F.col(c) for c in ("tp", "t", "p"))
    return {"precision": _ratio(tp, p), "recall": _ratio(tp, t), "f1": _ratio(2 * tp, t + p),
            "jaccard": _ratio(tp, t + p - tp)}


def macro_metrics(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro precision / recall / F1 / Jaccard, kappa, MCC and gmean from confusion cells.

    Macro averages run over labels of either side. gmean is the root of macro
    precision times macro recall.
    """
    per_label = label_counts(cells, by).withColumns(_scores())
    d = "double"
    sums = per_label.groupBy(*by).agg(
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1", "jaccard")],
        F.sum("t").cast(d).alias("_n"), F.sum("tp").cast(d).alias("_c"),
        F.sum(F.col("t").cast(d) * F.col("p")).alias("_tp"), F.sum(F.col("t").cast(d) * F.col("t")).alias("_tt"),
        F.sum(F.col("p").cast(d) * F.col("p")).alias("_pp"))
    n, c, tp, tt, pp = (F.col(x) for x in ("_n", "_c", "_tp", "_tt", "_pp"))
    spread = (n * n - pp) * (n * n - tt)
    chance = tp / (n * n)
    return sums.select(
        *by, (c / n).alias("accuracy"), "precision", "recall", "f1", "jaccard",
        F.when(chance < 1, 1 - (1 - c / n) / (1 - chance)).alias("kappa"),
        F.when(spread > 0, (c * n - tp) / F.sqrt(spread)).otherwise(0.0).alias("mcc"),
        F.sqrt(F.col("precision") * F.col("recall")).alias("gmean"))


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision and F1 of each true label."""
    scores = _scores()
    return label_counts(cells, by).where("t > 0").select(
        *by, "label", *[scores[s].alias(s) for s in ("recall", "precision", "f1")])


def accuracy(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def train_test_gap(df: DataFrame, truth: str, predicted: str, is_test: str = "is_test") -> DataFrame:
    """Accuracy on both splits and their difference."""
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    both = df.agg(F.avg(F.when(~F.col(is_test), hit)).alias("train_accuracy"),
                  F.avg(F.when(F.col(is_test), hit)).alias("test_accuracy"))
    return both.withColumn("train_test_gap", F.col("train_accuracy") - F.col("test_accuracy"))


#: Distinct scores that a range is meant to hold.
RANGE_SCORES = 50_000

#: Most ranges of a group; cuts are searched in two steps of the square root of it.
MAX_RANGES = 1024


def score_ranges(counts: DataFrame, score: str, by: Sequence[str] = (), target: int = RANGE_SCORES) -> DataFrame:
    """`counts` (one row per group and distinct score) with `_r`, the score's range within its group.

    Each group is cut at quantiles of its own distinct scores, into as many
    ranges of about `target` scores as it needs, at most MAX_RANGES. Ranges
    follow the order of the scores. A NULL score is in range 0; NaN is greatest.
    """
    step = int(MAX_RANGES ** 0.5)
    points = F.array(*[F.lit(i / MAX_RANGES) for i in range(1, MAX_RANGES)])
    keys = [f"_k{i}" for i in range(len(by))]
    groups = counts.groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(
        F.count(score).alias("_n"), F.percentile_approx(score, points, F.lit(8 * MAX_RANGES)).alias("_all"))
    every = F.floor(F.lit(MAX_RANGES) / F.least(F.ceil(F.col("_n") / target), F.lit(MAX_RANGES)))
    thinned = F.filter("_all", lambda c, i: (i + 1) % F.col("_every") == 0)
    groups = groups.withColumn("_every", F.greatest(every, F.lit(1))).select(
        *keys, F.coalesce(thinned, F.array().cast("array<double>")).alias("_cuts"))
    groups = groups.withColumn("_coarse", F.filter("_cuts", lambda c, i: i % step == step - 1))
    if by:
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
        on = same[0]
        for other in same[1:]:
            on = on & other
        cut = counts.join(groups, on).drop(*keys)
    else:
        one = groups.select(F.struct("_cuts", "_coarse").alias("_g")).scalar()
        cut = counts.withColumn("_g", one).withColumns({"_cuts": F.col("_g._cuts"), "_coarse": F.col("_g._coarse")}).drop("_g")
    lower = F.coalesce(F.size(F.filter("_coarse", lambda c: c < F.col(score))), F.lit(0)) * step
    fine = F.slice("_cuts", F.col("_lower") + 1, step - 1)
    inside = F.size(F.filter(fine, lambda c: c < F.col(score)))
    return cut.withColumn("_lower", lower).withColumn("_r", F.col("_lower") + inside).drop("_cuts", "_coarse", "_lower")


def rank_auc(df: DataFrame, score: str, positive: Column, by: Sequence[str] = (), target: int = RANGE_SCORES) -> DataFrame:
    """Binary ROC AUC per group with average ranks for ties; NULL where one side is empty.

    Rows shrink to distinct scores first. Each group's scores are cut into ranges
    of about `target` of its own, and every range is summed by itself; range
    totals then carry the ranks below, so no task sees all scores of a group.
    """
    pos = positive.cast("bigint")
    counts = df.groupBy(*by, F.col(score).cast("double").alias("_s")).agg(
        F.sum(pos).alias("_pos"), F.sum(1 - pos).alias("_neg"))
    ranged = score_ranges(counts, "_s", by, target)
    below = Window.partitionBy(*by, "_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("_below", F.coalesce(F.sum("_neg").over(below), F.lit(0)))
    parts = inside.groupBy(*by, "_r").agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_u"),
        F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    # At most MAX_RANGES rows per group from here on.
    before = Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.withColumn("_before", F.coalesce(F.sum("_neg").over(before), F.lit(0)))
    total = offset.groupBy(*by).agg(F.sum(F.col("_u") + F.col("_pos") * F.col("_before")).alias("_u"),
                                    F.sum("_pos").cast("double").alias("_p"), F.sum("_neg").cast("double").alias("_n"))
    return total.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                                    F.col("_u") / (F.col("_p") * F.col("_n"))).alias("auc"))


def macro_auc(df: DataFrame, truth: str, scores: Mapping[object, str], by: Sequence[str] = ()) -> DataFrame:
    """Mean one-vs-rest AUC over classes; NULL if any class lacks positives or negatives."""
    long = df.select(*by, F.col(truth).alias("_truth"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("_class"), F.col(s).cast("double").alias("_score")) for c, s in scores.items()])))
    each = rank_auc(long, "_score", F.col("_truth") == F.col("_class"), [*by, "_class"])
    return each.groupBy(*by).agg(F.when(F.count("auc") == len(scores), F.avg("auc")).alias("auc_macro"))


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of each metric over seeds, from `(seed, metric, value)`."""
    return runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def aggregate_folds(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of each metric over folds."""
    return folds.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
