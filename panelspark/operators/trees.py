"""Boosted trees and forests whose models grow together over one table.

Features are binned once, into at most 32 bins a column. Models (folds, the
refit, classes, both kinds of boosting, forests) differ in which rows they see,
not in the table: a pass over it gives the split statistics of all of them.

- A pass turns every block of rows into histograms per model, node, feature and
  bin. They are summed by (model, node), and what reaches the driver is one best
  split per node.
- Boosting takes one pass per level of a tree, the same pass for all boosters.
  Scores of rows are written every `SNAPSHOT` trees; the few trees since then
  are applied on the way.
- Forests draw Poisson weights from a hash of row and tree. Nodes above the
  bound grow by passes, all trees of a group at once; a node below it is sent to
  one task, which grows the rest of it.
- A model whose rows in all are below the bound (`LOCAL_CELLS` cells) is grown
  by one task, with many such models side by side.
- Rows of equal bins fall into the same nodes and, in a booster, have the same
  score. Boosters see each of them once with its counts; a forest draws every
  row's weights and adds them up by bins before it grows a tree.

Gradients are rounded to 2^-20, so sums are exact and do not depend on the order
or the partitioning of rows: the passes and the single tasks give the same trees,
and so does any layout of the input. Features must not be null; ties between
splits go to the lower feature and bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.runtime import cut_lineage

#: Bins of a column, as in Spark's own trees.
BINS = 32
#: Cells (rows x columns, a byte each, and 8 for the id of a row) of a model that one task may grow by itself.
LOCAL_CELLS = 64_000_000
#: Cells of a node that one task may finish.
NODE_CELLS = 4_000_000
#: Cells that a task of a pass takes.
TASK_CELLS = 8_000_000
#: Boosted trees between two written tables of scores.
SNAPSHOT = 20
#: Trees of a forest that grow together, by passes and in one task.
TREES_AT_ONCE, TREES_PER_TASK = 16, 25
_GRAIN = float(2**20)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
#: The weight that the first 12 bits of a drawn number give, and whether the others decide.
_WEIGHT, _HIGHEST = (np.searchsorted(_POISSON, (np.arange(4096) * 2.0**41 + more) / 2.0**53, side="right") for more in (0, 2**41 - 1))
_OPEN = _WEIGHT != _HIGHEST
#: Rows that are hashed, binned or walked down at once.
_BLOCK = 16_384


@dataclass(frozen=True)
class TreeSpec:
    """One model: rows of `fold` are held out (None: no row); a booster predicts class `target` against the rest.

    `l2` above 0 splits and fits by second-order statistics (and asks for a
    child's curvature of at least 1); 0 splits by the variance of residuals.
    """

    kind: str
    trees: int
    depth: int
    fold: int | None = None
    target: int = 1
    rate: float = 0.1
    l2: float = 0.0
    seed: int = 42


@dataclass
class Tree:
    """Nodes as arrays; the right child follows the left, and a leaf leads to itself."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while True:
            to = self.left[node] + (bins[rows, self.feature[node]] > self.bin[node])
            if (to == node).all():
                return node
            node = to


@dataclass
class TreeModel:
    """A fitted model: all trees in one set of arrays."""

    spec: TreeSpec
    cuts: list[np.ndarray]
    base: float
    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @classmethod
    def of(cls, spec: TreeSpec, cuts: list[np.ndarray], base: float, trees: Sequence[Tree]) -> "TreeModel":
        sizes = np.array([len(t.left) for t in trees])
        starts = np.cumsum(sizes) - sizes
        join = lambda name: np.concatenate([getattr(t, name) for t in trees])
        return cls(spec, cuts, base, join("feature"), join("bin"), join("left") + np.repeat(starts, sizes), join("value"), starts)

    def probabilities(self, bins: np.ndarray, chunk: int = _BLOCK) -> np.ndarray:
        """Forests: one column per class. Boosters: the score of `target` as one column."""
        forest = self.spec.kind == "forest"
        out = [np.zeros((0, self.value.shape[1] if forest else 1))]
        for start in range(0, len(bins), chunk):
            part = bins[start:start + chunk]
            if forest:
                total = np.zeros((len(part), self.value.shape[1]))
                for leaf in self._leaves(part):
                    total += self.value[leaf]
                out.append(total / len(self.roots))
            else:
                steps = np.empty((len(part), len(self.roots)))
                for tree, leaf in enumerate(self._leaves(part)):
                    steps[:, tree] = self.value[leaf, 0]
                out.append(_sigmoid(self.base + steps.sum(axis=1))[:, None])
        return np.concatenate(out)

    def _leaves(self, part: np.ndarray) -> Iterator[np.ndarray]:
        """The leaf of every row, tree by tree; rows that have arrived are left behind."""
        flat, places = part.ravel(), np.arange(len(part)) * part.shape[1]
        at_leaf = self.left == np.arange(len(self.left))
        for root in self.roots:
            out = np.full(len(part), root)
            rows = np.arange(len(part) if not at_leaf[root] else 0)
            node, place = out[rows], places[rows]
            while len(rows):
                node = self.left[node] + (flat[place + self.feature[node]] > self.bin[node])
                there = at_leaf[node]
                if 4 * np.count_nonzero(there) >= len(rows):
                    out[rows[there]] = node[there]
                    on = np.flatnonzero(~there)
                    rows, node, place = rows[on], node[on], place[on]
            yield out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of rows: how many cuts lie below a value."""
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint8)


def find_cuts(df: DataFrame, features: str, width: int) -> list[np.ndarray]:
    """At most `BINS` - 1 cuts per column at its quantiles, in one aggregation."""
    shares = [i / BINS for i in range(1, BINS + 1)]
    row = df.agg(*[F.percentile_approx(F.col(features)[i], shares, 10_000).alias(f"c{i}") for i in range(width)]).first()
    found = [sorted(set(v or [0.0])) for v in row]
    # the greatest value of a column parts nothing; a cut lies between a value and the next bin's first
    return [np.array(v[:-1] if len(v) > 1 else v, float) for v in found]


def _mix(*parts) -> np.ndarray:
    """A hash of whole numbers, broadcast over arrays."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return h


def bootstrap(ids: np.ndarray, spec: TreeSpec, tree: int) -> np.ndarray:
    """How often each row stands in the sample of a tree: Poisson with mean 1."""
    out = np.empty(len(ids), np.int64)
    for start in range(0, len(ids), _BLOCK):
        h = _mix(spec.seed, -1 if spec.fold is None else spec.fold, tree, ids[start:start + _BLOCK])
        first = h >> np.uint64(52)
        w = _WEIGHT[first]
        at = np.flatnonzero(_OPEN[first])
        w[at] = np.searchsorted(_POISSON, (h[at] >> np.uint64(11)).astype(float) / 2.0**53, side="right")
        out[start:start + _BLOCK] = w
    return out


def collapsed(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of bins, and which of them each row is."""
    if not len(bins):
        return bins, np.zeros(0, np.int64)
    words = -(-bins.shape[1] // 8)
    wide = np.zeros((len(bins), words * 8), np.uint8)
    wide[:, :bins.shape[1]] = bins
    keys = wide.view(np.uint64)
    if words > 1:  # a hash of the row stands for it, unless two different rows share one
        hashed = _mix(*keys.T)
        _, first, at = np.unique(hashed, return_index=True, return_inverse=True)
        if not (bins[first[at]] == bins).all():
            _, first, at = np.unique(wide.view(f"V{words * 8}").ravel(), return_index=True, return_inverse=True)
    else:
        _, first, at = np.unique(keys[:, 0], return_index=True, return_inverse=True)
    return bins[first], at.ravel()


def _node_features(spec: TreeSpec, tree: int, paths: np.ndarray, width: int) -> np.ndarray:
    """Columns a node may split on: all for boosters, a drawn square root of them for forests."""
    if spec.kind == "boost":
        return np.broadcast_to(np.arange(width), (len(paths), width))
    few = math.ceil(math.sqrt(width))
    order = _mix(spec.seed, -1 if spec.fold is None else spec.fold, tree, paths[:, None], np.arange(width)[None, :])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :few], axis=1)


def _histogram(bins: np.ndarray, node: np.ndarray, stats: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sums of `stats` by node, feature slot and bin."""
    nodes, slots = features.shape
    flat, places, own = bins.ravel(), np.arange(len(bins)) * bins.shape[1], node * BINS
    out, columns = np.empty((nodes, slots, BINS, stats.shape[1])), np.ascontiguousarray(stats.T)
    for slot in range(slots):
        cell = own + flat[places + features[node, slot]]
        for s, values in enumerate(columns):
            out[:, slot, :, s] = np.bincount(cell, values, nodes * BINS).reshape(nodes, BINS)
    return out


def _best(hist: np.ndarray, spec: TreeSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node: slot and bin of the best split, whether there is one, and the sums of both children."""
    left = hist.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    if spec.kind == "forest":
        def score(s):
            n = s.sum(axis=-1)
            return (s**2).sum(axis=-1) / np.maximum(n, 1), n > 0
    elif spec.l2 > 0:
        def score(s):
            return (s[..., 1] / _GRAIN)**2 / (s[..., 2] / _GRAIN + spec.l2), s[..., 2] >= _GRAIN
    else:
        def score(s):
            return (s[..., 1] / _GRAIN)**2 / np.maximum(s[..., 0], 1), s[..., 0] > 0
    (a, ok_a), (b, ok_b), (t, _) = score(left), score(right), score(total)
    gain = np.where(ok_a & ok_b, a + b - t, -np.inf)
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    rows = np.arange(len(gain))
    slot, cut = at // BINS, at % BINS
    return slot, cut, flat[rows, at] > 1e-7, left[rows, slot, cut], right[rows, slot, cut]


def _leaf(sums: np.ndarray, spec: TreeSpec) -> np.ndarray:
    """Values of leaves: class shares, or a step of the score."""
    if spec.kind == "forest":
        return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1)
    step = sums[:, 1] / np.maximum(sums[:, 2] + spec.l2 * _GRAIN, 1e-6 * _GRAIN)
    return (spec.rate * np.clip(step, -8, 8))[:, None]


class Grower:
    """One tree on its way down; `paths` number its open nodes, children of p being 2p + 1 and 2p + 2."""

    def __init__(self, spec: TreeSpec, tree: int, width: int, sums: np.ndarray, path: int = 0, depth: int = 0):
        self.spec, self.tree, self.width, self.depth = spec, tree, width, depth
        self.feature, self.bin, self.left = np.zeros(1, np.int32), np.full(1, 255, np.uint8), np.zeros(1, np.int64)
        self.value = _leaf(sums[None], spec)
        self.open, self.paths, self.sums = np.array([0]), np.array([path], np.int64), sums[None]
        self.grafts: list[tuple[int, Tree]] = []
        self._drop_closed()

    def keep(self, chosen: np.ndarray) -> None:
        """Only these open nodes stay open."""
        self.open, self.paths, self.sums = self.open[chosen], self.paths[chosen], self.sums[chosen]
        self._features: np.ndarray | None = None

    def _drop_closed(self) -> None:
        keep = np.full(len(self.open), self.depth < self.spec.depth)
        if self.spec.kind == "forest":
            keep &= (self.sums > 0).sum(axis=1) > 1
        self.keep(keep)

    def features(self) -> np.ndarray:
        if self._features is None:
            self._features = _node_features(self.spec, self.tree, self.paths, self.width)
        return self._features

    def split(self, slot, cut, good, left, right) -> None:
        """Turn open nodes with a good split into two open ones each."""
        chosen = self.features()[np.arange(len(slot)), slot]
        at, first = np.flatnonzero(good), len(self.left)
        self.depth += 1
        if not len(at):
            self.open = self.open[:0]
            return
        nodes, born = self.open[at], first + np.arange(2 * len(at))
        self.feature[nodes], self.bin[nodes], self.left[nodes] = chosen[at], cut[at], born[::2]
        self.feature = np.concatenate([self.feature, np.zeros(len(born), np.int32)])
        self.bin = np.concatenate([self.bin, np.full(len(born), 255, np.uint8)])
        self.left = np.concatenate([self.left, born])
        self.open, self.paths = born, (2 * self.paths[at, None] + [1, 2]).ravel()
        self.sums = np.stack([left[at], right[at]], axis=1).reshape(len(born), -1)
        self.value = np.concatenate([self.value, _leaf(self.sums, self.spec)])
        self._drop_closed()

    def graft(self, node: int, sub: Tree) -> None:
        """Put a subtree in the place of a node."""
        self.grafts.append((node, sub))

    def done(self) -> Tree:
        feature, bin_, left, value = self.feature.copy(), self.bin.copy(), self.left.copy(), self.value
        more, size = [], len(left)
        for node, sub in self.grafts:
            moved = np.where(sub.left == 0, node, sub.left + size - 1)
            feature[node], bin_[node], left[node] = sub.feature[0], sub.bin[0], moved[0]
            more.append((sub.feature[1:], sub.bin[1:], moved[1:], sub.value[1:]))
            size += len(sub.left) - 1
        parts = list(zip((feature, bin_, left, value), *more))
        return Tree(*(np.concatenate(p).astype(t) for p, t in zip(parts, (np.int32, np.uint8, np.int64, float))))


def _grow(grower: Grower, bins: np.ndarray, stats: np.ndarray) -> Tree:
    """Finish a tree over the rows at hand."""
    node = np.zeros(len(bins), np.int64)
    while len(grower.open):
        place = np.full(len(grower.left), -1)
        place[grower.open] = np.arange(len(grower.open))
        at = place[node]
        keep = at >= 0
        bins, stats, node, at = bins[keep], stats[keep], node[keep], at[keep]
        grower.split(*_best(_histogram(bins, at, stats, grower.features()), grower.spec))
        node = grower.left[node] + (bins[np.arange(len(node)), grower.feature[node]] > grower.bin[node])
    return grower.done()


def _gradients(score: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Count, gradient and curvature, in whole grains, of `rows` rows of a score, `hits` of them of the target class."""
    p = _sigmoid(score)
    gradient = hits * np.rint((1 - p) * _GRAIN) + (rows - hits) * np.rint(-p * _GRAIN)
    return np.stack([rows, gradient, rows * np.maximum(np.rint(p * (1 - p) * _GRAIN), 1)], axis=1)


def _class_sums(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    out = np.zeros((len(y), classes))
    out[np.arange(len(y)), y] = w
    return out


def _grow_boosted(grower: Grower, columns: np.ndarray, stats: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A tree over rows of bins given by column, and the leaf of every row.

    Of two children only the one of fewer rows is summed; the other is the rest of their node.
    """
    width, rows = columns.shape
    node, places, whole = np.zeros(rows, np.int64), np.arange(rows), np.zeros((0, width, BINS, 3))
    by_stat = np.ascontiguousarray(stats.T)
    while len(grower.open):
        place = np.full(len(grower.left), -1)
        place[grower.open] = np.arange(len(grower.open))
        at, least = place[node], np.arange(len(grower.open))
        if len(whole):
            size = np.bincount(at[at >= 0], minlength=len(least)).reshape(-1, 2)
            least = 2 * np.arange(len(size)) + (size[:, 1] < size[:, 0])
        slot = np.full(len(grower.open) + 1, -1)
        slot[least] = np.arange(len(least))
        slot = slot[at]
        some = np.flatnonzero(slot >= 0)
        own, values = slot[some] * BINS, by_stat[:, some]
        hist = np.empty((len(grower.open), width, BINS, 3))
        for j in range(width):
            cell = own + columns[j, some]
            for s in range(3):
                hist[least, j, :, s] = np.bincount(cell, values[s], len(least) * BINS).reshape(-1, BINS)
        if len(whole):
            hist[least ^ 1] = whole - hist[least]
        splits = _best(hist, grower.spec)
        grower.split(*splits)
        whole = hist[splits[2]]
        node = grower.left[node] + (columns[grower.feature[node], places] > grower.bin[node])
    return grower.done(), node


def _boost_local(spec: TreeSpec, base: float, bins: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> list[Tree]:
    score, trees, columns = np.full(len(bins), base), [], np.ascontiguousarray(bins.T)
    for t in range(spec.trees):
        stats = _gradients(score, rows, hits)
        tree, leaf = _grow_boosted(Grower(spec, t, bins.shape[1], stats.sum(axis=0)), columns, stats)
        score = score + tree.value[leaf, 0]
        trees.append(tree)
    return trees


def _forest_tree(spec: TreeSpec, tree: int, bins: np.ndarray, sums: np.ndarray, path: int = 0, depth: int = 0) -> Tree:
    """A tree over different rows of bins and the weight of each class there."""
    drawn = sums.any(axis=1)
    bins, sums = bins[drawn], sums[drawn]
    return _grow(Grower(spec, tree, bins.shape[1], sums.sum(axis=0), path, depth), bins, sums)


_BLOB = "unit int, tree int, path long, feature binary, bin binary, left binary, value binary"


def _pack(unit: int, tree: int, path: int, t: Tree) -> tuple:
    return unit, tree, path, t.feature.tobytes(), t.bin.tobytes(), t.left.tobytes(), t.value.tobytes()


def _table(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _BLOB.split(", ")])


def _rows_of(grown: DataFrame) -> Iterator:
    """Grown trees one after the other. They are written first: read as it is made, a table is made one partition at a time."""
    return cut_lineage(grown).toLocalIterator(prefetchPartitions=True)


def _unpack(row) -> Tree:
    left = np.frombuffer(row["left"], np.int64)
    return Tree(np.frombuffer(row["feature"], np.int32), np.frombuffer(row["bin"], np.uint8), left,
                np.frombuffer(row["value"], float).reshape(len(left), -1))


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, width)


@dataclass
class TreeTable:
    """The binned rows that models are fitted on: `_id`, `_y`, `_fold`, `_bins`."""

    rows: DataFrame
    cuts: list[np.ndarray]
    classes: int
    #: (fold, class) -> rows
    counts: dict[tuple[int, int], int] = field(default_factory=dict)

    @cached_property
    def groups(self) -> DataFrame:
        """The different rows by fold and class, `_n` rows each."""
        grouped = self.rows.groupBy("_y", "_fold", "_bins").agg(F.count(F.lit(1)).alias("_n"))
        return cut_lineage(grouped.repartition(self.rows.rdd.getNumPartitions(), "_bins"))

    @cached_property
    def group_counts(self) -> dict[int, int]:
        """fold -> different rows"""
        return {r[0]: r[1] for r in self.groups.groupBy("_fold").count().collect()}

    def cells(self, spec: TreeSpec) -> int:
        """What a task that grows a model by itself must hold."""
        rows = self.size(spec) if spec.kind == "forest" else sum(n for f, n in self.group_counts.items() if f != spec.fold)
        return rows * (self.width + 8)

    def size(self, spec: TreeSpec) -> int:
        return sum(n for (f, _), n in self.counts.items() if f != spec.fold)

    def base(self, spec: TreeSpec) -> float:
        """The log-odds of the target among the rows that a booster sees."""
        hits = sum(n for (f, c), n in self.counts.items() if f != spec.fold and c == spec.target)
        n = self.size(spec)
        return math.log(max(hits, 0.5) / max(n - hits, 0.5))

    @property
    def width(self) -> int:
        return len(self.cuts)


def tree_table(data: DataFrame, key: str, label: str, fold: str, features: str, width: int, n_classes: int) -> TreeTable:
    """Bin `features` (an array of doubles) once for all models; `fold` may be null for rows that no model holds out."""
    cuts = find_cuts(data, features, width)
    counts = {(r[0], r[1]): r[2] for r in data.groupBy(F.coalesce(fold, F.lit(-1)), label).count().collect()}

    def binned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, width))
            found = to_bins(x, cuts)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_y"), b.column("_fold"),
                                              pa.array([r.tobytes() for r in found], pa.binary())], names=names)

    names = ["_id", "_y", "_fold", "_bins"]
    tasks = max(1, math.ceil(sum(counts.values()) * width / TASK_CELLS))
    picked = data.select(F.xxhash64(key).alias("_id"), F.col(label).cast("int").alias("_y"),
                         F.coalesce(fold, F.lit(-1)).cast("int").alias("_fold"), F.col(features).alias("x"))
    rows = cut_lineage(picked.mapInArrow(binned, "_id long, _y int, _fold int, _bins binary").repartition(tasks, "_id"))
    return TreeTable(rows, cuts, n_classes, counts)


def fit_trees(table: TreeTable, specs: Sequence[TreeSpec]) -> list[TreeModel]:
    """All models, small ones one task each, large ones by shared passes."""
    near = [i for i, s in enumerate(specs) if table.cells(s) <= LOCAL_CELLS]
    trees: dict[int, list[Tree]] = _fit_near(table, specs, near) if near else {}
    far = [i for i in range(len(specs)) if i not in trees]
    boosts = [i for i in far if specs[i].kind == "boost"]
    if boosts:
        trees |= dict(zip(boosts, _boost_by_passes(table, [specs[i] for i in boosts])))
    for i in far:
        if specs[i].kind == "forest":
            trees[i] = _forest_by_passes(table, specs[i])
    return [TreeModel.of(s, table.cuts, table.base(s) if s.kind == "boost" else 0.0, trees[i]) for i, s in enumerate(specs)]


def _packed(rows: DataFrame, number: str) -> DataFrame:
    """Rows in blocks of one fold: `_fold` and the bytes of `number` (id or count), class and bins."""
    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            fold, y, n = (b.column(c).to_numpy() for c in ("_fold", "_y", number))
            flat = np.frombuffer(b"".join(b.column("_bins").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            for f in np.unique(fold):
                own = fold == f
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f], pa.int32()), *(pa.array([x[own].tobytes()], pa.binary()) for x in (n.astype(np.int64), y.astype(np.int32), flat))],
                    names=["_fold", "n", "y", "bins"])

    return rows.mapInArrow(pack, "_fold int, n binary, y binary, bins binary")


def _fit_near(table: TreeTable, specs: Sequence[TreeSpec], chosen: list[int]) -> dict[int, list[Tree]]:
    """Models below the bound: one task per booster and per `TREES_PER_TASK` trees of a forest."""
    found: dict[int, dict[int, Tree]] = {i: {} for i in chosen}
    for kind, rows, number in (("boost", "groups", "_n"), ("forest", "rows", "_id")):
        units = [(i, t) for i in chosen if specs[i].kind == kind for t in (
            range(0, specs[i].trees, TREES_PER_TASK) if kind == "forest" else [0])]
        if units:
            for row in _near_units(table, specs, units, _packed(getattr(table, rows), number)):
                found[units[row["unit"]][0]][row["tree"]] = _unpack(row)
    return {i: [found[i][t] for t in sorted(found[i])] for i in chosen}


def _near_units(table: TreeTable, specs: Sequence[TreeSpec], units: list[tuple[int, int]], packed: DataFrame) -> Iterator:
    width, classes = table.width, table.classes
    bases = {i: table.base(specs[i]) for i, _ in units if specs[i].kind == "boost"}
    held = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(-2 if specs[i].fold is None else specs[i].fold).alias("f"))
                     for u, (i, _) in enumerate(units)])
    dealt = (packed.withColumn("_unit", F.explode(held)).where("_unit.f <> _fold")
             .select(F.col("_unit.unit").alias("unit"), "n", "y", "bins").repartitionByRange(len(units), "unit"))

    def grow(part: pa.Table) -> pa.Table:
        unit = part.column("unit")[0].as_py()
        i, first = units[unit]
        spec = specs[i]
        n, y, flat = (np.frombuffer(b"".join(part.column(c).to_pylist()), t) for c, t in (("n", np.int64), ("y", np.int32), ("bins", np.uint8)))
        bins, at = collapsed(flat.reshape(-1, width))
        if spec.kind == "boost":
            rows, hits = (np.bincount(at, w, len(bins)) for w in (n, n * (y == spec.target)))
            grown = enumerate(_boost_local(spec, bases[i], bins, rows, hits))
        else:
            cell, size = at * classes + y, len(bins) * classes
            sums = ((t, np.bincount(cell, bootstrap(n, spec, t), size).reshape(-1, classes))
                    for t in range(first, min(first + TREES_PER_TASK, spec.trees)))
            grown = ((t, _forest_tree(spec, t, bins, own)) for t, own in sums)
        return _table([_pack(unit, t, 0, tree) for t, tree in grown])

    return _rows_of(dealt.groupBy("unit").applyInArrow(grow, _BLOB))


_SPLIT = "model int, node int, slot int, cut int, good boolean, left binary, right binary"


def _summed_splits(hists: DataFrame, specs: Sequence[TreeSpec], stats: int) -> dict[tuple[int, int], tuple]:
    """Best split per (model, node) from histograms by task; one row each reaches the driver."""
    def best(part: pd.DataFrame) -> pd.DataFrame:
        model, node = int(part["model"].iloc[0]), int(part["node"].iloc[0])
        total = sum(np.frombuffer(h, float) for h in part["hist"]).reshape(1, -1, BINS, stats)
        slot, cut, good, left, right = _best(total, specs[model])
        return pd.DataFrame([(model, node, int(slot[0]), int(cut[0]), bool(good[0]), left[0].tobytes(), right[0].tobytes())],
                            columns=[c.split()[0] for c in _SPLIT.split(", ")])

    return {(r["model"], r["node"]): (r["slot"], r["cut"], r["good"], np.frombuffer(r["left"], float), np.frombuffer(r["right"], float))
            for r in hists.groupBy("model", "node").applyInPandas(best, _SPLIT).collect()}


def _emit(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (model, node), hist in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.int32()), pa.array([node], pa.int32()),
                                          pa.array([hist.tobytes()], pa.binary())], names=["model", "node", "hist"])


def _apply_splits(growers: dict[int, Grower], splits: dict[tuple[int, int], tuple]) -> None:
    for m, g in growers.items():
        rows = [splits[m, int(n)] for n in g.open]
        g.split(*(np.array([r[k] for r in rows]) for k in range(5)))


def _boost_by_passes(table: TreeTable, specs: Sequence[TreeSpec]) -> list[list[Tree]]:
    """All boosters at once, level by level; a tree's root counts are known from its first pass."""
    width = table.width
    bases = [table.base(s) for s in specs]
    rows = table.groups.withColumn("_score", F.array(*map(F.lit, bases)))
    trees: list[list[Tree]] = [[] for _ in specs]
    since = 0

    def scored(b: pa.RecordBatch, newer: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray]:
        bins = _matrix(b.column("_bins").to_pylist(), width)
        score = np.stack(b.column("_score").to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, len(specs)))
        score = score.copy()
        for m, later in enumerate(newer):
            for t in later:
                score[:, m] += t.value[t.leaves(bins), 0]
        return bins, score

    for number in range(max(s.trees for s in specs)):
        live = [m for m, s in enumerate(specs) if number < s.trees]
        growers = {m: Grower(specs[m], number, width, np.array([2.0, 0.0, _GRAIN])) for m in live}
        while any(len(g.open) for g in growers.values()):
            newer = [t[since:] for t in trees]
            partial = {m: (g.done(), g.open) for m, g in growers.items() if len(g.open)}

            def level(parts: Iterator[pa.RecordBatch], newer=newer, partial=partial) -> Iterator[pa.RecordBatch]:
                found: dict[tuple[int, int], np.ndarray] = {}
                for b in parts:
                    bins, score = scored(b, newer)
                    y, fold, n = (b.column(c).to_numpy() for c in ("_y", "_fold", "_n"))
                    for m, (tree, opened) in partial.items():
                        place = np.full(len(tree.left), -1)
                        place[opened] = np.arange(len(opened))
                        at = place[tree.leaves(bins)]
                        seen = (at >= 0) & (fold != (-2 if specs[m].fold is None else specs[m].fold))
                        stats = _gradients(score[seen, m], n[seen], n[seen] * (y[seen] == specs[m].target))
                        all_columns = np.broadcast_to(np.arange(width), (len(opened), width))
                        hist = _histogram(bins[seen], at[seen], stats, all_columns)
                        for i, node in enumerate(opened):
                            found[m, int(node)] = found.get((m, int(node)), 0) + hist[i]
                yield from _emit(found)

            splits = _summed_splits(rows.mapInArrow(level, "model int, node int, hist binary"), specs, 3)
            for m, g in growers.items():
                if g.depth == 0:  # a root that is not split keeps the value of all rows
                    _, _, _, left, right = splits[m, 0]
                    g.value[0] = _leaf((left + right)[None], specs[m])[0]
            _apply_splits({m: g for m, g in growers.items() if len(g.open)}, splits)
        for m, g in growers.items():
            trees[m].append(g.done())
        if (number + 1) % SNAPSHOT == 0:
            newer = [t[since:] for t in trees]

            def add(parts: Iterator[pa.RecordBatch], newer=newer) -> Iterator[pa.RecordBatch]:
                for b in parts:
                    _, score = scored(b, newer)
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns[:-1], pa.array(score.tolist(), pa.list_(pa.float64()))], names=b.schema.names)

            rows = cut_lineage(rows.mapInArrow(add, rows.schema))
            since = number + 1
    return trees


def _forest_by_passes(table: TreeTable, spec: TreeSpec) -> list[Tree]:
    """A forest above the bound: big nodes by passes, small ones finished in tasks of their own."""
    out: list[Tree] = []
    for first in range(0, spec.trees, TREES_AT_ONCE):
        out += _grow_group(table, spec, range(first, min(first + TREES_AT_ONCE, spec.trees)))
    return out


def _grow_group(table: TreeTable, spec: TreeSpec, numbers: range) -> list[Tree]:
    width, classes = table.width, table.classes
    rows = table.rows.where(F.col("_fold") != (-2 if spec.fold is None else spec.fold))
    bound = min(LOCAL_CELLS, NODE_CELLS) // width

    def members(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _matrix(b.column("_bins").to_pylist(), width), b.column("_y").to_numpy(), b.column("_id").to_numpy()

    # roots have at least two classes until the first pass says otherwise
    growers = {t: Grower(spec, t, width, np.full(classes, float(bound + 1))) for t in numbers}
    small: dict[tuple[int, int], tuple[int, int]] = {}
    while any(len(g.open) for g in growers.values()):
        partial = {t: (g.done(), g.open, g.features()) for t, g in growers.items() if len(g.open)}

        def level(parts: Iterator[pa.RecordBatch], partial=partial) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for b in parts:
                bins, y, ids = members(b)
                for t, (tree, opened, features) in partial.items():
                    place = np.full(len(tree.left), -1)
                    place[opened] = np.arange(len(opened))
                    at, w = place[tree.leaves(bins)], bootstrap(ids, spec, t)
                    seen = (at >= 0) & (w > 0)
                    hist = _histogram(bins[seen], at[seen], _class_sums(y[seen], w[seen], classes), features)
                    for i, node in enumerate(opened):
                        found[t, int(node)] = found.get((t, int(node)), 0) + hist[i]
            yield from _emit(found)

        one = dict.fromkeys(numbers, spec)
        splits = _summed_splits(rows.mapInArrow(level, "model int, node int, hist binary"), one, classes)
        for t, g in growers.items():
            if len(g.open) and g.depth == 0:
                _, _, _, left, right = splits[t, 0]
                g.value[0] = _leaf((left + right)[None], spec)[0]
        _apply_splits({t: g for t, g in growers.items() if len(g.open)}, splits)
        for t, g in growers.items():
            few = g.sums.sum(axis=1) <= bound if len(g.open) else np.zeros(0, bool)
            small |= {(t, int(n)): (int(p), g.depth) for n, p in zip(g.open[few], g.paths[few])}
            g.keep(~few)
    if small:
        finished = {t: g.done() for t, g in growers.items()}

        def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                bins, y, ids = members(b)
                for t, tree in finished.items():
                    at, w = tree.leaves(bins), bootstrap(ids, spec, t)
                    go = (w > 0) & np.isin(at, [n for u, n in small if u == t])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(go.sum(), t), pa.int32()), pa.array(at[go], pa.int64()), pa.array(y[go], pa.int32()),
                         pa.array(w[go], pa.int32()), pa.array([r.tobytes() for r in bins[go]], pa.binary())],
                        names=["unit", "node", "y", "w", "bins"])

        def finish(part: pd.DataFrame) -> pd.DataFrame:
            t, node = int(part["unit"].iloc[0]), int(part["node"].iloc[0])
            path, depth = small[t, node]
            bins, at = collapsed(_matrix(part["bins"], width))
            sums = np.bincount(at * classes + part["y"].to_numpy(), part["w"].to_numpy(), len(bins) * classes).reshape(-1, classes)
            tree = _forest_tree(spec, t, bins, sums, path, depth)
            return pd.DataFrame([_pack(t, node, path, tree)], columns=[c.split()[0] for c in _BLOB.split(", ")])

        dealt = rows.mapInArrow(deal, "unit int, node long, y int, w int, bins binary")
        dealt = dealt.repartition(max(1, min(len(small), 4096)), "unit", "node")
        for row in _rows_of(dealt.groupBy("unit", "node").applyInPandas(finish, _BLOB)):
            growers[row["unit"]].graft(row["tree"], _unpack(row))
    return [growers[t].done() for t in numbers]


def class_scores(models: Sequence[TreeModel], bins: np.ndarray, n_classes: int) -> np.ndarray:
    """Class probabilities of one learner: a forest, one booster, or one booster per class scaled to sum 1."""
    if models[0].spec.kind == "forest":
        return models[0].probabilities(bins)
    each = np.concatenate([m.probabilities(bins) for m in models], axis=1)
    if n_classes == 2:
        return np.concatenate([1 - each, each], axis=1)
    total = each.sum(axis=1, keepdims=True)
    return np.where(total > 0, each / np.where(total > 0, total, 1), 1.0 / n_classes)
