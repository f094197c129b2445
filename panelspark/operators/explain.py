"""Attribution of a score to survey answers, and its roll-ups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations
from math import comb, factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.cluster import fit_starts
from panelspark.operators.encode import vector_column
from panelspark.runtime import bounded_rows


def owner_feature(column: Column, features: Sequence[str]) -> Column:
    """The longest feature name that a design column equals or extends with `_`; else the column itself."""
    rule = None
    for f in sorted(features, key=len, reverse=True):
        hit = (column == f) | column.startswith(f"{f}_")
        rule = F.when(hit, f) if rule is None else rule.when(hit, f)
    return column if rule is None else rule.otherwise(column)


def owned_columns(columns: Sequence[str], features: Sequence[str]) -> dict[str, list[str]]:
    """Design columns of each feature, by the same longest-prefix rule."""
    owned: dict[str, list[str]] = {}
    for c in columns:
        fits = [f for f in features if c == f or c.startswith(f"{f}_")]
        owned.setdefault(max(fits, key=len) if fits else c, []).append(c)
    return owned


def to_long(attribution: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """A table with one attribution column per design column as `(keys, column, phi)`."""
    return attribution.select(*keys, *[f"`{c}`" for c in columns]).unpivot(list(keys), list(columns), "column", "phi")


def by_feature(attribution: DataFrame, columns: Sequence[str], features: Sequence[str],
               keys: Sequence[str] = ("hhid", "wave", "zone")) -> DataFrame:
    """Importance `(keys, feature, importance)`: the sum of |phi| over each feature's columns.

    `attribution` has one row per household, so the sums stay inside the row.
    """
    owned = owned_columns(columns, features)
    sums = []
    for f, members in owned.items():
        parts = [F.abs(F.col(f"`{c}`")) for c in members]
        sums.append(sum(parts[1:], parts[0]).alias(f))
    return attribution.select(*keys, *sums).unpivot(list(keys), list(owned), "feature", "importance")


def by_feature_long(attribution: DataFrame, features: Sequence[str],
                    keys: Sequence[str] = ("hhid", "wave", "zone")) -> DataFrame:
    """The same from a stored long table."""
    owned = attribution.withColumn("feature", owner_feature(F.col("column"), features))
    return owned.groupBy(*keys, "feature").agg(F.sum(F.abs("phi")).alias("importance"))


# ---- background ------------------------------------------------------------

@dataclass(frozen=True)
class Background:
    """A few weighted rows that stand for the population."""

    rows: tuple[tuple[float, ...], ...]
    weights: tuple[float, ...]

    def table(self, spark) -> DataFrame:
        data = [(i, list(r), w) for i, (r, w) in enumerate(zip(self.rows, self.weights))]
        return spark.createDataFrame(data, "b int, background array<double>, weight double")


def background_of(table: DataFrame, columns: Sequence[str], weight: str, limit: int = 1000) -> Background:
    """Background rows from a small table with a weight column."""
    rows = bounded_rows(table.select(*columns, weight), limit, "The background")
    total = float(sum(r[weight] for r in rows))
    return Background(tuple(tuple(float(r[c]) for c in columns) for r in rows),
                      tuple(float(r[weight]) / total for r in rows))


def summarise_background(df: DataFrame, columns: Sequence[str], size: int = 50, seed: int = 42) -> Background:
    """K-Means centres, each value moved to the nearest observed one, weighted by cluster size.

    The centres' values cut each column into ranges. Of the observed values of a
    range only the least and the greatest can be nearest to a centre, so one
    aggregation by (column, range) finds them all; the lower one wins a tie.
    """
    found = fit_starts(df, columns, [size], 1, seed)[size][0]
    centers = np.array(found.centers)
    edges = np.sort(centers, axis=0)

    def ends(parts):
        low, high = np.full((size + 1, len(columns)), np.inf), np.full((size + 1, len(columns)), -np.inf)
        for b in parts:
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, len(columns)))
            for j in range(len(columns)):
                at = np.searchsorted(edges[:, j], x[:, j], side="left")
                np.minimum.at(low[:, j], at, x[:, j])
                np.maximum.at(high[:, j], at, x[:, j])
        at, j = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(at, pa.int32()), pa.array(low[at, j]), pa.array(high[at, j])],
                                         names=["j", "at", "low", "high"])

    ranges = df.select(vector_column(columns, "x")).mapInArrow(ends, "j int, at int, low double, high double").groupBy("j", "at").agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    seen: dict[int, list[float]] = {}
    for r in bounded_rows(ranges, (size + 1) * len(columns), "The background"):
        seen.setdefault(r["j"], []).extend((r["low"], r["high"]))
    for j, values in seen.items():
        values = np.unique(values)
        centers[:, j] = values[np.abs(values[None, :] - centers[:, j, None]).argmin(axis=1)]
    total = float(sum(found.sizes))
    kept = [i for i, n in enumerate(found.sizes) if n > 0]
    return Background(tuple(tuple(centers[i].tolist()) for i in kept), tuple(found.sizes[i] / total for i in kept))


# ---- Shapley values --------------------------------------------------------

def coalition_design(m: int, budget: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Masks and kernel weights of the coalitions to score.

    Single columns and their complements are always listed: without them the
    fit has no unique solution. Further sizes are taken whole from the outside
    in while the budget covers their share of the kernel mass; the rest is drawn
    in complementary pairs.
    """
    if m > 1 and budget < (m if m == 2 else 2 * m):
        raise ValueError(f"{m} columns need at least {2 * m} coalitions; nsamples is {budget}.")
    sizes = list(range(1, m // 2 + 1))
    mass = np.array([(m - 1) / (s * (m - s)) * (1 if 2 * s == m else 2) for s in sizes])
    mass = mass / mass.sum() if len(mass) else mass
    chosen: dict[tuple[int, ...], float] = {}
    left, open_from = budget, 0
    for at, s in enumerate(sizes):
        count = comb(m, s) * (1 if 2 * s == m else 2)
        if at > 0 and count > left * mass[at] / mass[at:].sum() + 1e-9:
            break
        for subset in combinations(range(m), s):
            each = mass[at] / count
            chosen[subset] = each
            if 2 * s != m:
                chosen[tuple(i for i in range(m) if i not in subset)] = each
        left -= count
        open_from = at + 1
    rest = mass[open_from:]
    if len(rest):
        rng = np.random.default_rng(seed)
        drawn: dict[tuple[int, ...], int] = {}
        while left > 1:
            s = sizes[open_from + int(rng.choice(len(rest), p=rest / rest.sum()))]
            subset = tuple(sorted(rng.choice(m, s, replace=False).tolist()))
            other = tuple(i for i in range(m) if i not in subset)
            for item in (subset, other):
                left -= item not in drawn
                drawn[item] = drawn.get(item, 0) + 1
        total = sum(drawn.values())
        for item, n in drawn.items():
            chosen[item] = rest.sum() * n / total
    masks = np.zeros((len(chosen), m), dtype=bool)
    for row, subset in enumerate(chosen):
        masks[row, list(subset)] = True
    return masks, np.array(list(chosen.values()))


def _solver(masks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The linear map from coalition values to all attributions but the last."""
    edges = masks[:, :-1].astype(float) - masks[:, -1:].astype(float)
    weighted = edges.T * weights
    normal = weighted @ edges
    if np.linalg.matrix_rank(edges) < edges.shape[1]:
        raise ValueError("The coalitions do not determine every column; raise nsamples.")
    return np.linalg.solve(normal, weighted)


def coalition_values(foreground: DataFrame, keys: Sequence[str], values: str, background: Background,
                     masks: np.ndarray, score: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Mean score `(keys, s, v)` of each household with the answers of coalition `s` kept.

    Each household meets the fixed coalitions and background rows by id; the
    mean over the background combines before the shuffle.
    """
    spark = foreground.sparkSession
    # One shuffle of the narrow rows; both later groupings reuse its partitioning, and a stated
    # count keeps a small foreground spread over many tasks for the scoring.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    foreground = foreground.select(*keys, values).repartition(parts, *keys)
    design = spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(masks)], "s int, mask array<boolean>")
    kept = F.zip_with(F.col(values), F.col("mask"), lambda x, m: F.when(m, x))
    rows = foreground.select(*keys, values, F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("s"))
    rows = rows.join(F.broadcast(design), "s").select(
        *keys, "s", kept.alias("_kept"), F.explode(F.sequence(F.lit(0), F.lit(len(background.rows) - 1))).alias("b"))
    mixed = rows.join(F.broadcast(background.table(spark)), "b").select(
        *keys, "s", "weight", F.zip_with("_kept", "background", lambda x, b: F.coalesce(x, b)).alias("_mixed"))
    return score(mixed, "_mixed").groupBy(*keys, "s").agg(F.sum(F.col("weight") * F.col("score")).alias("v"))


def base_value(spark, background: Background, score: Callable[[DataFrame, str], DataFrame]) -> float:
    """The score expected over the background."""
    scored = score(background.table(spark), "background")
    return float(scored.agg(F.sum(F.col("weight") * F.col("score"))).first()[0])


def kernel_shap(foreground: DataFrame, keys: Sequence[str], columns: Sequence[str], background: Background,
                score: Callable[[DataFrame, str], DataFrame], nsamples: int = 500,
                seed: int = 42) -> tuple[DataFrame, float]:
    """One attribution column per design column for every household, and the base value.

    All households share one coalition design, so that solving is one fixed
    linear map. With every coalition in the design the values are exact Shapley
    values. A column that never differs from the background gets 0.
    """
    at = {c: i for i, c in enumerate(columns)}
    gaps = foreground.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for c, i in at.items()]).first()
    if any(gaps[f"n{i}"] for i in at.values()):
        raise ValueError(f"Missing answers cannot be explained: {[c for c, i in at.items() if gaps[f'n{i}']]}")
    limits = foreground.agg(*[F.min(f"`{c}`").alias(f"l{i}") for c, i in at.items()],
                            *[F.max(f"`{c}`").alias(f"h{i}") for c, i in at.items()]).first()
    fixed = [c for c, i in at.items() if {limits[f"l{i}"], limits[f"h{i}"]} | {r[i] for r in background.rows}
             == {background.rows[0][i]}]
    moving = [c for c in columns if c not in fixed]
    base = base_value(foreground.sparkSession, background, score)
    masks, weights = coalition_design(len(moving), nsamples, seed)
    solve = _solver(masks, weights) if len(moving) > 1 else np.zeros((0, 0))
    last = masks[:, -1].astype(float) if len(moving) > 1 else np.zeros(0)
    # Fixed columns ride along in every coalition; the last coalition is the household itself.
    full = np.ones((len(masks) + 1, len(columns)), dtype=bool)
    full[:len(masks), [at[c] for c in moving]] = masks
    values = coalition_values(foreground.select(*keys, vector_column(columns, "_x")), keys, "_x", background, full, score)
    count = len(masks)

    @F.pandas_udf("array<double>")
    def attribute(v: pd.Series) -> pd.Series:
        scores = np.array(v.tolist(), dtype=float)
        above = scores[:, count] - base
        head = (scores[:, :count] - base - np.outer(above, last)) @ solve.T if solve.size else np.zeros((len(scores), 0))
        return pd.Series(list(np.column_stack([head, above - head.sum(axis=1)])))

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("s", "v"))), lambda x: x["v"])
    solved = values.groupBy(*keys).agg(ordered.alias("_v")).select(*keys, attribute("_v").alias("_phi"))
    place = {c: i for i, c in enumerate(moving)}
    wide = [F.col("_phi")[place[c]].alias(c) if c in place else F.lit(0.0).alias(c) for c in columns]
    return solved.select(*keys, *wide), base


def exact_shapley(df: DataFrame, keys: Sequence[str], columns: Sequence[str], background: Background,
                  score: Callable[[Mapping[str, Column]], Column]) -> DataFrame:
    """Exact Shapley values of a closed-form score of few columns, in one projection."""
    m = len(columns)
    if m > 10:
        raise ValueError("Exact attribution lists every coalition: use at most 10 columns.")

    def value(members: frozenset[int]) -> Column:
        parts = [F.lit(w) * score({c: F.col(c) if i in members else F.lit(row[i]) for i, c in enumerate(columns)})
                 for row, w in zip(background.rows, background.weights)]
        return sum(parts[1:], parts[0])

    subsets = [frozenset(c) for s in range(m + 1) for c in combinations(range(m), s)]
    named = {subset: f"_v{i}" for i, subset in enumerate(subsets)}
    scored = df.select(*keys, *[value(subset).alias(name) for subset, name in named.items()])
    phi = []
    for j, c in enumerate(columns):
        terms = [F.lit(factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m))
                 * (F.col(named[s | {j}]) - F.col(named[s])) for s in subsets if j not in s]
        phi.append(sum(terms[1:], terms[0]).alias(c))
    return scored.select(*keys, *phi)


def expression_score(columns: Sequence[str], score: Callable[[Mapping[str, Column]], Column]):
    """A closed-form score as a scoring step for `kernel_shap`."""
    return lambda df, values: df.withColumn("score", score({c: F.col(values)[i] for i, c in enumerate(columns)}))
