"""K-Means labels and cluster-validity indices."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.columns import squared_distance
from panelspark.operators.encode import vector_column
from panelspark.runtime import bounded_rows, cut_lineage, fit_partitions


@dataclass(frozen=True)
class Clusters:
    """Centres in label order: row i of `centers` is label i."""

    columns: tuple[str, ...]
    centers: tuple[tuple[float, ...], ...]
    cost: float
    sizes: tuple[int, ...]

    def assign(self, df: DataFrame, name: str = "label") -> DataFrame:
        return assign_nearest(df, self.columns, self.centers, name)


def assign_nearest(df: DataFrame, columns: Sequence[str], centers: Sequence[Sequence[float]],
                   name: str = "label") -> DataFrame:
    """Index of the nearest centre; the lower index wins a tie."""
    distances = F.array(*[squared_distance(F.col("_v"), c) for c in centers])
    withv = df.withColumn("_v", vector_column(columns, "_v")).withColumn("_d", distances)
    nearest = (F.array_position("_d", F.array_min("_d")) - 1).cast("int")
    return withv.withColumn(name, F.when(F.exists("_v", lambda x: x.isNull()), None).otherwise(nearest)).drop("_v", "_d")


def order_by_norm(centers: Sequence[Sequence[float]]) -> list[int]:
    """Cluster ids by rising distance of their centre from the origin.

    The order names clusters the same way on every run; it does not say which
    one is poorer.
    """
    norms = [float(np.linalg.norm(c)) for c in centers]
    return sorted(range(len(norms)), key=lambda i: (norms[i], i))


def order_by_column(centers: Sequence[Sequence[float]], column: int) -> list[int]:
    """Cluster ids by rising centre value of a reference column."""
    return sorted(range(len(centers)), key=lambda i: (centers[i][column], i))


#: Distinct points that starting centres are drawn from; every point takes part in all passes.
START_POINTS = 10_000


def _starting_centers(points: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres far from each other, each drawn by its squared distance to those before."""
    rng, chance, chosen = np.random.default_rng(seed), weights.astype(float), []
    near = np.full(len(points), np.inf)
    for _ in range(k):
        total = chance.sum()
        at = int(np.searchsorted(np.cumsum(chance), rng.random() * total, side="right")) if total > 0 else int(rng.integers(len(points)))
        chosen.append(points[min(at, len(points) - 1)])
        near = np.minimum(near, ((points - chosen[-1])**2).sum(axis=1))
        chance = near * weights
    return np.array(chosen)


def fit_starts(df: DataFrame, columns: Sequence[str], ks: Sequence[int], n_init: int = 10, seed: int = 42, max_iter: int = 100,
               tol: float = 1e-4) -> dict[int, list[Clusters]]:
    """K-Means for every K from `n_init` starts each, all in the same passes; clusters in no particular order.

    Equal points collapse into one with a weight, in a layout that follows the
    number of distinct points. A pass assigns each point to the nearest centre of
    every start still moving, and one sum per (start, cluster, column) comes back.
    There are as many passes as the slowest start takes, and one for costs and sizes.
    """
    width = len(columns)
    points = cut_lineage(df.groupBy(vector_column(columns, "v")).agg(F.count(F.lit(1)).alias("w")))
    n = points.count()
    if not n:
        raise ValueError("K-Means needs at least one point.")
    points = cut_lineage(points.repartition(fit_partitions(n, width), "v").sortWithinPartitions("v"))
    first = points.orderBy(F.xxhash64("v"), "v").limit(START_POINTS).collect()
    x, w = np.array([r["v"] for r in first], float), np.array([r["w"] for r in first])
    starts = [(k, s) for k in ks for s in range(n_init)]
    centers = {i: _starting_centers(x, w, k, seed + s) for i, (k, s) in enumerate(starts)}

    def totals(active: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Per start and cluster: column sums, weight and cost."""
        def add(parts):
            found = {i: np.zeros((len(c), width + 2)) for i, c in active.items()}
            for b in parts:
                if not b.num_rows:
                    continue
                x = np.stack(b.column("v").to_numpy(zero_copy_only=False))
                w = b.column("w").to_numpy().astype(float)
                for i, c in active.items():
                    gaps = np.stack([((x - one)**2).sum(axis=1) for one in c], axis=1)
                    own = gaps.argmin(axis=1)
                    for j in range(width):
                        found[i][:, j] += np.bincount(own, x[:, j] * w, len(c))
                    found[i][:, width] += np.bincount(own, w, len(c))
                    found[i][:, width + 1] += np.bincount(own, gaps[np.arange(len(x)), own] * w, len(c))
            rows = [(i, k, j, v) for i, t in found.items() for k, r in enumerate(t) for j, v in enumerate(r)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.float64()))],
                                             names=["s", "k", "j", "value"])

        out = {i: np.zeros((len(c), width + 2)) for i, c in active.items()}
        summed = points.mapInArrow(add, "s int, k int, j int, value double").groupBy("s", "k", "j").agg(F.sum("value").alias("value"))
        for r in summed.collect():
            out[r["s"]][r["k"], r["j"]] = r["value"]
        return out

    moving = dict(centers)
    for _ in range(max_iter):
        for i, t in totals(moving).items():
            filled = t[:, width] > 0
            new = centers[i].copy()
            new[filled] = t[filled, :width] / t[filled, width, None]
            still = (((new - centers[i])**2).sum(axis=1) > tol * tol).any()
            centers[i] = new
            moving.pop(i)
            if still:
                moving[i] = new
        if not moving:
            break
    found: dict[int, list[Clusters]] = {k: [] for k in ks}
    for i, t in totals(centers).items():
        found[starts[i][0]].append(Clusters(tuple(columns), tuple(map(tuple, centers[i].tolist())), float(t[:, width + 1].sum()),
                                            tuple(int(v) for v in t[:, width])))
    return found


def _ordered(best: Clusters, by_norm: bool) -> Clusters:
    order = order_by_norm(best.centers) if by_norm else range(len(best.centers))
    return Clusters(best.columns, tuple(best.centers[i] for i in order), best.cost, tuple(best.sizes[i] for i in order))


def fit_kmeans(df: DataFrame, columns: Sequence[str], k: int, n_init: int = 10, seed: int = 42,
               by_norm: bool = True, max_iter: int = 100, tol: float = 1e-4) -> Clusters:
    """K-Means with restarts: the start with the least cost is kept, the earliest at a tie."""
    return _ordered(min(fit_starts(df, columns, [k], n_init, seed, max_iter, tol)[k], key=lambda c: c.cost), by_norm)


def choose_k(df: DataFrame, columns: Sequence[str], candidates: Sequence[int] = (2, 3, 4, 5), n_init: int = 10,
             seed: int = 42, exact: bool = True) -> tuple[int, dict[int, float]]:
    """The candidate K with the best silhouette; K below 2 or not below the row count is skipped.

    `exact=False` ranks by the squared-Euclidean silhouette, which is linear in the rows.
    """
    n = df.count()
    fitting = [k for k in candidates if 2 <= k < n]
    if not fitting:
        raise ValueError(f"No K in {tuple(candidates)} fits {n} rows.")
    scores = {}
    for k, found in fit_starts(df, columns, fitting, n_init, seed).items():
        labelled = _ordered(min(found, key=lambda c: c.cost), True).assign(df)
        scores[k] = (silhouette(labelled, columns, "label").first()["silhouette"] if exact
                     else squared_silhouette(labelled, columns, "label"))
    return max(scores, key=lambda k: scores[k]), scores


@dataclass(frozen=True)
class _Block:
    """Distinct points: coordinates, and per point the weight under its cluster, for the clusters that are there."""

    x: np.ndarray
    weight: np.ndarray
    clusters: np.ndarray

    @staticmethod
    def of(cluster: bytes, w: bytes, v: bytes) -> _Block:
        own, w = np.frombuffer(cluster, np.int64), np.frombuffer(w, np.int64)
        clusters, at = np.unique(own, return_inverse=True)
        weight = np.zeros((len(own), len(clusters)))
        weight[np.arange(len(own)), at] = w
        return _Block(np.frombuffer(v, float).reshape(len(own), -1), weight, clusters)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All Euclidean distances, by one matrix product; pairs so near that it would cancel are measured by column."""
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        square = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            square += (x[:, j, None] - y[None, :, j])**2
        return np.sqrt(square)
    middle = x.mean(axis=0)
    a, b = x - middle, y - middle
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    square = np.column_stack([a, na, np.ones(len(a))]) @ np.column_stack([-2 * b, np.ones(len(b)), nb]).T
    r, c = np.nonzero(square <= (1e-6 * (na + nb.max()))[:, None])
    for at in range(0, len(r), 100_000):
        i, j = r[at:at + 100_000], c[at:at + 100_000]
        square[i, j] = ((x[i] - y[j])**2).sum(axis=1)
    return np.sqrt(square, out=square)


def _block_sums(pairs):
    """Weighted distance sums of every point to each cluster, one row per block and task; a pair of blocks serves both."""
    blocks: dict[int, _Block] = {}
    sums: dict[int, dict[int, np.ndarray]] = {}

    def add(block: int, clusters: np.ndarray, found: np.ndarray) -> None:
        own = sums.setdefault(block, {})
        for k, cluster in enumerate(clusters.tolist()):
            own[cluster] = own.get(cluster, 0.0) + found[:, k]

    for batch in pairs:
        columns = [batch.column(i) for i in range(8)]
        for row in range(batch.num_rows):
            both = []
            for side in (columns[:4], columns[4:]):
                block = side[0][row].as_py()
                if block not in blocks:
                    blocks[block] = _Block.of(*(c[row].as_py() for c in side[1:]))
                both.append((block, blocks[block]))
            (i, left), (j, right) = both
            distance = _distances(left.x, right.x)
            add(i, right.clusters, distance @ right.weight)
            if i != j:
                add(j, left.clusters, distance.T @ left.weight)
    for block, own in sums.items():
        clusters = np.array(sorted(own), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([clusters.tobytes()], pa.binary()),
             pa.array([np.stack([own[c] for c in clusters.tolist()], axis=1).tobytes()], pa.binary())], names=["block", "clusters", "sums"])


#: Blocks of a partition, so that what a task of the pairing holds is bounded, and partitions that make enough tasks.
_BLOCKS_AT_ONCE, _PAIRED = 64, 16


def silhouette_points(df: DataFrame, columns: Sequence[str], label: str, block_rows: int = 1024) -> DataFrame:
    """Exact Euclidean silhouette `(cluster, w, silhouette)` of each distinct point, w rows each.

    Equal points collapse first. Points are packed into bounded blocks, which are
    written once; a task reads two partitions of them, meets every pair of blocks
    once and sends one row of distance sums per block, so neither pairs nor copies
    of blocks are written. The work stays quadratic in distinct points;
    `squared_silhouette` is linear.
    """
    points = cut_lineage(df.groupBy(F.col(label).cast("int").alias("cluster"), vector_column(columns, "v")).agg(
        F.count(F.lit(1)).alias("w")))
    found = bounded_rows(points.groupBy("cluster").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("points")), 100_000, "The set of clusters")
    if any(r["cluster"] is None for r in found):
        raise ValueError(f"The label {label} is missing for some rows.")
    sizes = {r["cluster"]: float(r["n"]) for r in found}
    blocks = max(1, -(-sum(r["points"] for r in found) // block_rows))
    parts = max(min(blocks, _PAIRED), -(-blocks // _BLOCKS_AT_ONCE))

    def pack(part: pa.Table) -> pa.Table:
        v = part.column("v").combine_chunks()
        flat = (v.flatten() if len(v) else v).to_numpy(zero_copy_only=False).astype(float)
        cells = [part.column(c).to_numpy().astype(np.int64).tobytes() for c in ("cluster", "w")] + [flat.tobytes()]
        return pa.table([pa.array([part.column("block")[0].as_py()], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)],
                        names=["block", "cluster", "w", "v"])

    dealt = points.withColumn("block", F.pmod(F.xxhash64("cluster", "v"), F.lit(blocks)).cast("int")).repartitionByRange(parts, "block")
    packed = cut_lineage(dealt.groupBy("block").applyInArrow(pack, "block int, cluster binary, w binary, v binary"))
    other = packed.select(*[F.col(c).alias(f"_{c}") for c in packed.columns])
    sums = packed.crossJoin(other).where(F.col("block") <= F.col("_block")).mapInArrow(
        _block_sums, "block int, clusters binary, sums binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        cluster, w = (np.frombuffer(left.column(c)[0].as_py(), np.int64) for c in ("cluster", "w"))
        own, n = np.zeros(len(w)), np.array([sizes[c] for c in cluster.tolist()])
        total: dict[int, np.ndarray] = {}
        for clusters, cells in zip(right.column("clusters").to_pylist(), right.column("sums").to_pylist()):
            for c, column in zip(np.frombuffer(clusters, np.int64).tolist(), np.frombuffer(cells, float).reshape(len(w), -1).T):
                total[c] = total.get(c, 0.0) + column
        nearest = np.full(len(w), np.nan)
        for c, column in total.items():
            here = cluster == c
            own[here] = column[here]
            nearest[~here] = np.fmin(nearest[~here], column[~here] / sizes[c])
        a = own / np.maximum(n - 1, 1)
        top = np.maximum(a, nearest) if len(sizes) > 1 else a
        with np.errstate(invalid="ignore", divide="ignore"):
            each = np.where((n == 1) | (top == 0), 0.0, (nearest - a) / top)
        none = np.full(len(w), len(sizes) == 1) & (n > 1) & (top != 0)
        return pa.table({"cluster": pa.array(cluster, pa.int32()), "w": pa.array(w), "silhouette": pa.array(each, pa.float64(), mask=none)})

    return packed.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(score, "cluster int, w long, silhouette double")


def silhouette(df: DataFrame, columns: Sequence[str], label: str, block_rows: int = 1024) -> DataFrame:
    """Mean exact Euclidean silhouette as one row."""
    each = silhouette_points(df, columns, label, block_rows)
    return each.agg((F.sum(F.col("silhouette") * F.col("w")) / F.sum("w")).alias("silhouette"))


def squared_silhouette(df: DataFrame, columns: Sequence[str], label: str) -> float:
    """Spark's squared-Euclidean silhouette: another number than `silhouette`, linear in the rows."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    vectors = df.select(F.col(label).cast("double").alias("prediction"),
                        array_to_vector(vector_column(columns)).alias("features"))
    return float(ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vectors))


def _cluster_moments(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"`{c}`") for c in columns]).alias("center"),
        F.array(*[F.var_pop(f"`{c}`") for c in columns]).alias("variance"))


def calinski_harabasz(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Between over within dispersion, from one moment row per cluster."""
    moments = _cluster_moments(df, columns, label)
    flat = moments.select("cluster", "n", F.posexplode(F.arrays_zip("center", "variance")).alias("j", "m")).select(
        "cluster", "n", "j", F.col("m.center").alias("c"), F.col("m.variance").alias("v"))
    n = F.col("n").cast("double")
    per_column = flat.groupBy("j").agg(
        F.sum(n).alias("rows"), F.count(F.lit(1)).alias("k"), F.sum(n * F.col("v")).alias("within"),
        F.sum(n).alias("_n"), F.sum(n * F.col("c")).alias("_s"), F.collect_list(F.struct(n.alias("n"), "c")).alias("_c"))
    mean = F.col("_s") / F.col("_n")
    between = F.aggregate("_c", F.lit(0.0), lambda acc, x: acc + x["n"] * (x["c"] - mean) * (x["c"] - mean))
    total = per_column.withColumn("between", between).agg(
        F.sum("between").alias("b"), F.sum("within").alias("w"), F.max("rows").alias("n"), F.max("k").alias("k"))
    return total.select(F.when((F.col("w") > 0) & (F.col("k") > 1),
                               F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("n") - F.col("k"))))
                        .alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance."""
    # One row per cluster.
    centers = F.broadcast(_cluster_moments(df, columns, label).select("cluster", "center"))
    gap = F.sqrt(F.aggregate(F.zip_with(vector_column(columns), F.col("center"), lambda a, b: (a - b) * (a - b)),
                             F.lit(0.0), lambda acc, x: acc + x))
    spread = df.withColumn("cluster", F.col(label)).join(centers, "cluster").groupBy("cluster", "center").agg(
        F.avg(gap).alias("s"))
    # One struct per cluster: the table of clusters fits in a row.
    packed = spread.agg(F.collect_list(F.struct("cluster", "center", "s")).alias("all"))
    pairs = packed.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).where(
        "a.cluster <> b.cluster")
    apart = F.sqrt(F.aggregate(F.zip_with("a.center", "b.center", lambda x, y: (x - y) * (x - y)),
                               F.lit(0.0), lambda acc, x: acc + x))
    ratio = F.when(apart > 0, (F.col("a.s") + F.col("b.s")) / apart).otherwise(0.0)
    worst = pairs.groupBy("a.cluster").agg(F.max(ratio).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))
