"""Regularised boosted demand and revenue regressors.

Second-order boosting over binned features. Feature rows are binned once and written as
blocks; a pass over the blocks gives the gradient histogram of one tree level, summed by
node, feature and bin, and the splits are picked from that table, whose size the
settings fix. Leaf values carry L1 and L2 penalties, children need a minimum weight, and each split learns
where missing values go. Gradients are summed as whole numbers, so trees don't depend on
the order of rows or tasks.

A training may take thousands of such passes. On tables of few rows the start of a job takes longer than a
pass, so there a task holds the blocks and grows many trees a job. Larger tables take a job a level over all tasks, and
the driver picks the splits. Both give the same trees. Margins are written anew every few trees: a pass replays only
the trees since, and a lost executor costs its part of one pass, or one job of trees.

A missing feature (null or NaN) is a bin of its own. Rows without a label are not trained on. Equal
labels give a model without trees that predicts them; no rows to train on, one that predicts zero.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faregrid.storage import staged

# Feature columns in training order.
MAIN_FEATURES = (
    "ft_1", "ft_2", "ft_3", "ft_4", "ft_5",
    "exp_avg", "hour", "day_of_week", "is_weekend", "is_rush_hour",
    "cluster_id",
)
LIBRARY_FEATURES = (
    "ft_1", "ft_2", "ft_3", "ft_4", "ft_5",
    "cluster_lat", "cluster_lon",
    "day_of_week", "hour_of_day", "is_weekend", "is_rush_hour", "is_holiday", "month",
    "exp_avg", "rolling_avg_7", "rolling_avg_30",
)
# Bins of a feature beside the one of missing values; a bin is one byte.
MAX_BINS = 255
BLOCK_ROWS = 1 << 16
# Up to so many tasks send their sums to the driver, a table of fixed size each; more are added up by a shuffle first.
FEW_TASKS = 16
# Trees after which margins are written.
REWRITE = 16
# Up to so many rows (30 bytes each) are held by a task that grows so many trees a job; there, a pass takes it less time
# than the start of a job.
HELD_ROWS = 1 << 20
TREES_A_JOB = 64


@dataclass(frozen=True)
class BoostParams:
    """Settings of one regressor; the defaults are the published ones of demand.

    With a validation slice, training ends once ``patience`` trees in a row have not brought its
    error to a new low, and the trees up to the lowest are kept.
    """

    trees: int = 1000
    depth: int = 3
    learning_rate: float = 0.1
    subsample: float = 0.8
    column_share: float = 0.8
    min_child_weight: float = 3.0
    gamma: float = 0.0
    l1: float = 200.0
    l2: float = 200.0
    patience: int = 10
    bins: int = MAX_BINS
    seed: int = 42


DEMAND = BoostParams(depth=3)
REVENUE = BoostParams(depth=4, l1=100.0, l2=100.0)
# Fixed value: the published feature rows, of which 70 % are trained on.
PUBLISHED_ROWS = 400_926 * 7 // 10


def for_rows(p: BoostParams, rows: int) -> BoostParams:
    """``p`` with the penalties of a table of ``rows`` training rows.

    A leaf's gradient and weight grow with its rows and the penalties don't, so on a small table
    the published ones would forbid nearly all steps. Here they keep their size per row.
    """
    share = min(1.0, rows / PUBLISHED_ROWS)
    return replace(p, l1=p.l1 * share, l2=p.l2 * share)


@dataclass
class Tree:
    """A complete binary tree in heap order: node i has children 2i+1 (left) and 2i+2. Feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    @property
    def depth(self) -> int:
        return (len(self.feature) + 1).bit_length() - 2

    def _walk(self, n: int, goes_left) -> np.ndarray:
        """Node each of ``n`` rows ends in; ``goes_left`` gets rows and the nodes they are at."""
        node = np.zeros(n, np.int64)
        for _ in range(self.depth):
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                break
            at = node[inner]
            node[inner] = 2 * at + np.where(goes_left(inner, at), 1, 2)
        return node

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        """Node of each row of a matrix of bins."""

        def left(rows, at):
            b = bins[rows, self.feature[at]]
            return np.where(b == 0, self.missing_left[at], b <= self.bin[at])

        return self._walk(len(bins), left)

    def of_values(self, values: np.ndarray) -> np.ndarray:
        """Node of each row of a matrix of feature values."""

        def left(rows, at):
            x = values[rows, self.feature[at]]
            return np.where(np.isnan(x), self.missing_left[at], x <= self.threshold[at])

        return self._walk(len(values), left)


@dataclass
class Booster:
    """A fitted model: feature columns in order, the start value and the trees."""

    features: tuple[str, ...]
    prediction: str
    base: float
    trees: list[Tree] = field(default_factory=list)

    def predict(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(values), self.base)
        for tree in self.trees:
            out += tree.value[tree.of_values(values)]
        return out


def _numeric(df: DataFrame, features: Sequence[str]) -> list[Column]:
    return [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The first ``n`` columns as doubles, null as NaN."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(n)]
    return np.column_stack(columns) if n else np.empty((len(batch), 0))


def bin_edges(df: DataFrame, features: Sequence[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Per feature up to ``bins`` - 1 edges: values at even ranks, or all distinct ones if there are few."""
    probabilities = [k / bins for k in range(1, bins)]
    sketched = df.select(_numeric(df, features)).approxQuantile([f"f{i}" for i in range(len(features))], probabilities, 0.25 / bins)
    return [np.unique([x for x in found if not np.isnan(x)]) for found in sketched]


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin 0 for missing values, else one more than the edges below the value."""
    out = np.zeros(values.shape, np.uint8)
    for i, edge in enumerate(edges):
        out[:, i] = np.where(np.isnan(values[:, i]), 0, 1 + np.searchsorted(edge, values[:, i], "left"))
    return out


_BLOCK = "first long, bins binary, label binary, held binary, margin binary"
_NAMES = ["first", "bins", "label", "held", "margin"]


def _block(columns: Sequence) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.binary()] * 4]
    values = [c.tobytes() if isinstance(c, np.ndarray) else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], _NAMES)


def _blocks(edges: Sequence[np.ndarray], base: float):
    """Blocks of binned rows from features, label, validation mark and row number."""
    n = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                rows = batch.slice(at, BLOCK_ROWS)
                label = rows.column(n).to_numpy(zero_copy_only=False).astype(np.float64)
                held = rows.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
                first = rows.column(n + 2)[0].as_py()
                yield _block([first, binned(_matrix(rows, n), edges), label, held, np.full(len(label), base)])

    return run


def _unpacked(batch: pa.RecordBatch, row: int, n_features: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first, bins, label, held, margin = (batch.column(i)[row].as_py() for i in range(5))
    arrays = np.frombuffer(bins, np.uint8).reshape(-1, n_features), np.frombuffer(label), np.frombuffer(held, bool), np.frombuffer(margin)
    return first, *arrays


def _replayed(margin: np.ndarray, bins: np.ndarray, trees: Sequence[Tree]) -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.of_bins(bins)]
    return margin


def drawn(first: int, n: int, seed: int, tree: int, share: float) -> np.ndarray:
    """Which of ``n`` rows from number ``first`` on a tree is grown on; the same for a row whatever its task."""
    x = np.arange(first, first + n, dtype=np.uint64) + np.uint64((seed * 1_000_003 + tree) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) < share * 2.0**53


_Part = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _level_sums(parts: Iterable[_Part], columns: Sequence[int], width: int, grown: Tree, level: int, number: int, p: BoostParams, scale: float) -> np.ndarray:
    """Rows of cells, gradients and weights of one level of the tree that grows, over blocks with their margins; the cell -1
    holds the validation error. Cells count nodes of the level, then features, then bins."""
    nodes = 2**level
    gradient, weight = (np.zeros((nodes, len(columns), width)) for _ in range(2))
    error, n_held = 0.0, 0
    for first, matrix, label, held, margin in parts:
        if level == 0:
            error += float(((margin[held] - label[held]) ** 2).sum())
            n_held += int(held.sum())
        use = np.flatnonzero(~held & drawn(first, len(label), p.seed, number, p.subsample))
        at = grown.of_bins(matrix[use]) - (nodes - 1)
        inside = at >= 0
        use, at = use[inside], at[inside]
        # Whole numbers: sums are exact in any order.
        g = np.rint((margin[use] - label[use]) * scale)
        for i, column in enumerate(columns):
            cell = at * width + matrix[use, column]
            gradient[:, i] += np.bincount(cell, g, nodes * width).reshape(nodes, width)
            weight[:, i] += np.bincount(cell, minlength=nodes * width).reshape(nodes, width)
    found = np.flatnonzero(weight)
    return np.stack([np.append(found, -1.0), np.append(gradient.flat[found], error), np.append(weight.flat[found], n_held)])


def _histogram(n_features: int, columns: Sequence[int], width: int, since: Sequence[Tree], grown: Tree, level: int, number: int, p: BoostParams, scale: float):
    """(cell, gradient, weight) of one level of the tree that grows, added up per task."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
        for batch in batches:
            for row in range(len(batch)):
                first, matrix, label, held, margin = _unpacked(batch, row, n_features)
                yield first, matrix, label, held, _replayed(margin, matrix, since)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, gradient, weight = _level_sums(parts(batches), columns, width, grown, level, number, p, scale)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(gradient), pa.array(weight)], ["cell", "gradient", "weight"])

    return run


def _shrunk(gradient: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)


def leaf_value(gradient, weight, p: BoostParams):
    """Step that lowers the penalised loss most, times the learning rate."""
    return -p.learning_rate * _shrunk(gradient, p.l1) / np.maximum(weight + p.l2, 1e-300)


def _score(gradient, weight, p: BoostParams):
    return _shrunk(gradient, p.l1) ** 2 / np.maximum(weight + p.l2, 1e-300)


def best_split(gradient: np.ndarray, weight: np.ndarray, p: BoostParams) -> tuple[float, int, int, bool, tuple, tuple] | None:
    """(gain, feature, bin, whether missing values go left, left sums, right sums) for a node's histogram
    (features x bins, bin 0 missing), or None. The first of equal gains by feature, bin and side."""
    total_g, total_w = gradient.sum(axis=1, keepdims=True), weight.sum(axis=1, keepdims=True)
    below = [x[:, 1:].cumsum(axis=1)[:, :-1] for x in (gradient, weight)]
    gains, lefts = [], []
    for missing in (True, False):
        g, w = (b + missing * x[:, :1] for b, x in zip(below, (gradient, weight)))
        gain = 0.5 * (_score(g, w, p) + _score(total_g - g, total_w - w, p) - _score(total_g, total_w, p)) - p.gamma
        gain[(w < p.min_child_weight) | (total_w - w < p.min_child_weight)] = -np.inf
        gains.append(gain)
        lefts.append((g, w))
    stacked = np.stack(gains, axis=2)
    if not stacked.size or stacked.max() <= 1e-12:
        return None
    feature, cut, side = np.unravel_index(int(stacked.argmax()), stacked.shape)
    left = tuple(float(x[feature, cut]) for x in lefts[side])
    right = float(total_g[feature, 0]) - left[0], float(total_w[feature, 0]) - left[1]
    return float(stacked[feature, cut, side]), int(feature), int(cut) + 1, side == 0, left, right


def _grow(edges: Sequence[np.ndarray], number: int, p: BoostParams, scale: float, sums_of: Callable) -> tuple[Tree, float | None]:
    """The next tree, and the validation error before it; ``sums_of`` gives a level's cells, gradients and weights
    from its columns, bins, the tree so far and the level."""
    rng = np.random.default_rng([p.seed, number])
    kept = max(1, int(p.column_share * len(edges)))
    columns = sorted(rng.permutation(len(edges))[:kept].tolist())
    width = max(len(e) for e in edges) + 2
    tree, error = Tree.empty(p.depth), None
    for level in range(p.depth):
        cell, g, w = sums_of(columns, width, tree, level)
        if level == 0 and (n_held := w[cell == -1].sum()):
            error = float(g[cell == -1].sum() / n_held)
        # The last place takes the error's cell.
        cells = 2**level * len(columns) * width
        place = np.where(cell < 0, cells, cell).astype(np.int64)
        sums = [np.bincount(place, x, cells + 1)[:-1] for x in (g / scale, w)]
        gradient, weight = (x.reshape(2**level, len(columns), width) for x in sums)
        if level == 0:
            tree.value[0] = leaf_value(gradient[0, 0].sum(), weight[0, 0].sum(), p)
        grew = False
        for node in range(2**level):
            at = 2**level - 1 + node
            if level and tree.feature[(at - 1) // 2] < 0:
                continue
            split = best_split(gradient[node], weight[node], p)
            if split is None:
                continue
            gain, i, cut, missing_left, left, right = split
            tree.feature[at], tree.bin[at], tree.missing_left[at], tree.gain[at] = columns[i], cut, missing_left, gain
            # A cut after the last edge parts missing values from all others.
            edge = edges[columns[i]]
            tree.threshold[at] = edge[cut - 1] if cut <= len(edge) else np.inf
            tree.value[2 * at + 1], tree.value[2 * at + 2] = leaf_value(*left, p), leaf_value(*right, p)
            grew = True
        if not grew:
            break
    return tree, error


def _by_jobs(blocks: DataFrame, n_features: int, since: Sequence[Tree], number: int, p: BoostParams, scale: float, few: bool) -> Callable:
    """A level's sums by a job of its own."""

    def sums_of(columns: Sequence[int], width: int, tree: Tree, level: int) -> list[np.ndarray]:
        run = _histogram(n_features, columns, width, since, tree, level, number, p, scale)
        found = blocks.mapInArrow(run, "cell long, gradient double, weight double")
        if not few:
            found = found.groupBy("cell").agg(F.sum("gradient").alias("gradient"), F.sum("weight").alias("weight"))
        return [c.to_numpy() for c in found.toArrow().columns]

    return sums_of


@dataclass
class _Progress:
    """How far a training is: trees kept so far, the lowest validation error and the trees it was reached with."""

    n: int = 0
    best: float = np.inf
    best_at: int = 0
    ended: bool = False

    def keeps(self, tree: Tree, error: float | None, p: BoostParams) -> bool:
        """Whether the training goes on with ``tree``; ``error`` is the one before it."""
        if error is not None:
            if error < self.best:
                self.best, self.best_at = error, self.n
            elif self.n - self.best_at >= p.patience:
                self.ended = True
                return False
        if tree.feature[0] < 0 and tree.value[0] == 0:  # the penalties leave nothing to learn
            self.ended = True
            return False
        self.n += 1
        self.ended = self.n >= p.trees
        return True


_NODE = np.dtype([("feature", "i8"), ("bin", "i8"), ("threshold", "f8"), ("missing_left", "?"), ("value", "f8"), ("gain", "f8")])


def _tree_bytes(tree: Tree) -> bytes:
    nodes = np.empty(len(tree.feature), _NODE)
    for name in _NODE.names:
        nodes[name] = getattr(tree, name)
    return nodes.tobytes()


def _tree_of(found: bytes) -> Tree:
    nodes = np.frombuffer(found, _NODE)
    return Tree(*(nodes[name].copy() for name in _NODE.names))


class _HeldRows:
    """Blocks a task holds while it grows trees. A level counts only the smaller child of each node; the other one is what is
    left of the node. Sums are whole numbers, so both are exact."""

    def __init__(self, parts: Sequence[_Part], n_features: int):
        self.firsts = [first for first, *_ in parts]
        self.ends = np.cumsum([0, *(len(label) for _, _, label, _, _ in parts)]).tolist()
        # One feature after the other.
        self.bins = np.concatenate([np.empty((0, n_features), np.uint8), *(matrix for _, matrix, *_ in parts)]).T.copy()
        self.label, self.held, self.margin = (np.concatenate([np.empty(0, kind), *(part[i] for part in parts)]) for i, kind in ((2, float), (3, bool), (4, float)))

    def _stretches(self) -> Iterator[tuple[int, slice]]:
        return ((first, slice(*ends)) for first, ends in zip(self.firsts, zip(self.ends, self.ends[1:])))

    def sums_of(self, number: int, p: BoostParams, scale: float) -> Callable:
        def sums_of(columns: Sequence[int], width: int, tree: Tree, level: int) -> np.ndarray:
            nodes, error, n_held = 2**level, 0.0, 0
            if level == 0:
                for _, at in self._stretches():
                    error += float(((self.margin[at][self.held[at]] - self.label[at][self.held[at]]) ** 2).sum())
                n_held = int(self.held.sum())
                draws = [drawn(first, at.stop - at.start, p.seed, number, p.subsample) for first, at in self._stretches()]
                self.rows = np.flatnonzero(~self.held & np.concatenate([np.empty(0, bool), *draws]))
                self.g = np.rint((self.margin[self.rows] - self.label[self.rows]) * scale)
                self.node = np.zeros(len(self.rows), np.int64)
                counted, smaller = slice(None), None
            else:
                inner = tree.feature[self.node] >= 0
                self.rows, self.g, node = self.rows[inner], self.g[inner], self.node[inner]
                b = self.bins[tree.feature[node], self.rows]
                self.node = 2 * node + np.where(np.where(b == 0, tree.missing_left[node], b <= tree.bin[node]), 1, 2)
                sizes = np.bincount(self.node - (nodes - 1), minlength=nodes).reshape(-1, 2)
                smaller = (sizes[:, :1] <= sizes[:, 1:]) == [[True, False]]
                counted = np.flatnonzero(smaller.ravel()[self.node - (nodes - 1)])
            node, rows, g = (self.node - (nodes - 1))[counted] * width, self.rows[counted], self.g[counted]
            gradient, weight = (np.zeros((nodes, len(columns), width)) for _ in range(2))
            for i, column in enumerate(columns):
                cell = node + self.bins[column][rows]
                gradient[:, i] = np.bincount(cell, g, nodes * width).reshape(nodes, width)
                weight[:, i] = np.bincount(cell, minlength=nodes * width).reshape(nodes, width)
            if level:
                split = np.repeat(tree.feature[nodes // 2 - 1 : nodes - 1] >= 0, 2)
                for now, before in zip((gradient, weight), self.before):
                    left_over = np.repeat(before, 2, axis=0) - now.reshape(-1, 2, *now.shape[1:])[:, ::-1].reshape(now.shape)
                    other = split & ~smaller.ravel()
                    now[other] = left_over[other]
            self.before = gradient, weight
            found = np.flatnonzero(weight)
            return np.stack([np.append(found, -1.0), np.append(gradient.flat[found], error), np.append(weight.flat[found], n_held)])

        return sums_of

    def add(self, tree: Tree) -> None:
        self.margin = _replayed(self.margin, self.bins.T, [tree])

    def blocks(self) -> Iterator[pa.RecordBatch]:
        for first, at in self._stretches():
            yield _block([first, self.bins[:, at].T, self.label[at], self.held[at], self.margin[at]])


def _many_trees(edges: Sequence[np.ndarray], progress: _Progress, p: BoostParams, scale: float):
    """Blocks with their margins after the next trees, then a row a tree with the error before it; the last tree is one
    that is not kept if the training ends by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _HeldRows([_unpacked(batch, row, len(edges)) for batch in batches for row in range(len(batch))], len(edges))
        now, grown = replace(progress), []
        while not now.ended and len(grown) < TREES_A_JOB:
            tree, error = _grow(edges, now.n, p, scale, rows.sums_of(now.n, p, scale))
            grown.append((now.n, tree, error))
            if now.keeps(tree, error, p):
                rows.add(tree)
        for block in rows.blocks():
            yield _with_tree(block)
        for number, tree, error in grown:
            yield _with_tree(_block([None] * 5), number, _tree_bytes(tree), error)

    return run


def _with_tree(block: pa.RecordBatch, number: int | None = None, tree: bytes | None = None, error: float | None = None) -> pa.RecordBatch:
    columns = [pa.array([number], pa.int64()), pa.array([tree], pa.binary()), pa.array([error], pa.float64())]
    return pa.RecordBatch.from_arrays([*block.columns, *columns], [*_NAMES, "number", "tree", "error"])


def _grown_at_once(blocks: DataFrame, edges: Sequence[np.ndarray], progress: _Progress, p: BoostParams, scale: float) -> tuple[DataFrame, list[tuple[Tree, float | None]]]:
    """Blocks with margins after the next trees, and those trees with the errors before them, by one task."""
    schema = f"{_BLOCK}, number long, tree binary, error double"
    written = staged(blocks.coalesce(1).mapInArrow(_many_trees(edges, progress, p, scale), schema), "boost-blocks")
    found = written.where("tree is not null").select("number", "tree", "error").collect()  # TREES_A_JOB at most
    return written.where("tree is null").select(_NAMES), [(_tree_of(r.tree), r.error) for r in sorted(found, key=lambda r: r.number)]


def _with_margins(since: Sequence[Tree], n_features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                first, bins, label, held, margin = _unpacked(batch, row, n_features)
                yield _block([first, bins, label, held, _replayed(margin, bins, since)])

    return run


def fit_regressor(
    train: DataFrame,
    features: Sequence[str],
    label: str,
    prediction: str,
    p: BoostParams = DEMAND,
    validation_column: str | None = None,
) -> Booster:
    """Fit boosted trees on the feature columns, in the given order.

    Rows where ``validation_column`` is true are not trained on; they end the training and choose
    how many trees stay.
    """
    if not 0 < p.bins <= MAX_BINS:
        raise ValueError("a bin is one byte")
    held = F.coalesce(F.col(validation_column).cast("boolean"), F.lit(False)) if validation_column else F.lit(False)
    known = F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))
    rows = train.where(known).select(*_numeric(train, features), F.col(label).cast("double").alias("label"), held.alias("held"), F.monotonically_increasing_id().alias("row"))
    rows = staged(rows, "boost-rows")
    mine = rows.where(~F.col("held"))
    n, base, low, high = mine.agg(F.count(F.lit(1)), F.avg("label"), F.min("label"), F.max("label")).first()
    model = Booster(tuple(features), prediction, float(base or 0.0))
    if not n or low == high:
        return model
    edges = bin_edges(mine, [f"f{i}" for i in range(len(features))], p.bins)
    # Sums of all gradients stay whole numbers below 2**52.
    scale = 2.0 ** np.floor(52 - np.log2(n * 4 * (high - low)))
    n_rows = rows.count()
    tasks, at_once = -(-n_rows // BLOCK_ROWS), n_rows <= HELD_ROWS
    blocks = staged(rows.coalesce(tasks).mapInArrow(_blocks(edges, model.base), _BLOCK), "boost-blocks")
    progress, since = _Progress(ended=p.trees < 1), []
    while not progress.ended:
        if at_once:
            blocks, grown = _grown_at_once(blocks, edges, progress, p, scale)
        else:
            sums_of = _by_jobs(blocks, len(edges), since, progress.n, p, scale, tasks <= FEW_TASKS)
            grown = [_grow(edges, progress.n, p, scale, sums_of)]
        kept = [tree for tree, error in grown if progress.keeps(tree, error, p)]
        model.trees += kept
        if not at_once:
            since += kept
        if len(since) == REWRITE:
            blocks = staged(blocks.coalesce(tasks).mapInArrow(_with_margins(since, len(features)), _BLOCK), "boost-blocks")
            since = []
    if validation_column and progress.best < np.inf:
        error = _error_after(blocks, since, len(features))
        model.trees = model.trees if error is not None and error < progress.best else model.trees[: progress.best_at]
    return model


def _error_after(blocks: DataFrame, since: Sequence[Tree], n_features: int) -> float | None:
    """Validation error with all trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                _, bins, label, held, margin = _unpacked(batch, row, n_features)
                off = (_replayed(margin, bins, since)[held] - label[held]) ** 2
                yield pa.RecordBatch.from_arrays([pa.array([off.sum()]), pa.array([len(off)])], ["error", "n"])

    return blocks.mapInArrow(run, "error double, n long").agg((F.sum("error") / F.sum("n"))).first()[0]


def score(model: Booster, df: DataFrame) -> DataFrame:
    """Add the model's prediction; the model selects its own columns."""

    @F.pandas_udf("double")
    def predicted(values: pd.DataFrame) -> pd.Series:
        return pd.Series(model.predict(values.to_numpy(np.float64, na_value=np.nan)))

    return df.withColumn(model.prediction, predicted(F.struct(*_numeric(df, model.features))))


def tree_count(model: Booster) -> int:
    """Trees the training kept."""
    return len(model.trees)


def fit_stacked(
    train: DataFrame, demand: BoostParams = DEMAND, revenue: BoostParams = REVENUE, validation: Column | None = None
) -> tuple[Booster, Booster]:
    """Demand model, then a revenue model that also sees the predicted demand.

    Rows that fulfil ``validation`` are not trained on; they end the training early.
    """
    held = None
    if validation is not None:
        held = "_held_out"
        train = train.withColumn(held, validation)
    first = fit_regressor(train, MAIN_FEATURES, "demand", "demand_pred", demand, held)
    second = fit_regressor(
        score(first, train), [*MAIN_FEATURES, "demand_pred"], "revenue_total", "revenue_pred", revenue, held
    )
    return first, second


def score_stacked(models: tuple[Booster, Booster], df: DataFrame) -> DataFrame:
    first, second = models
    return score(second, score(first, df))


NODES = "tree int, node int, feature string, threshold double, missing_left boolean, value double, gain double"


def node_table(spark: SparkSession, model: Booster) -> DataFrame:
    """One row per node of the trees; leaves have no feature. As many rows as trees and their nodes."""
    rows = []
    for number, tree in enumerate(model.trees):
        reached = [0]
        for node in reached:
            inner = tree.feature[node] >= 0
            if inner:
                reached += [2 * node + 1, 2 * node + 2]
            name = model.features[tree.feature[node]] if inner else None
            numbers = (float(tree.threshold[node]), bool(tree.missing_left[node]), float(tree.value[node]), float(tree.gain[node]))
            rows.append((number, node, name, *numbers))
    return spark.createDataFrame(rows, NODES)


def model_of(nodes: DataFrame, features: Sequence[str], prediction: str, base: float) -> Booster:
    """The model of a node table."""
    trees: list[Tree] = []
    rows = nodes.orderBy("tree", "node").collect()  # as many as the trees have nodes
    deepest = max((int(r.node) + 1).bit_length() - 1 for r in rows) if rows else 0
    place = {name: i for i, name in enumerate(features)}
    for r in rows:
        while len(trees) <= r.tree:
            trees.append(Tree.empty(deepest))
        tree = trees[r.tree]
        tree.feature[r.node] = -1 if r.feature is None else place[r.feature]
        tree.threshold[r.node], tree.missing_left[r.node], tree.value[r.node], tree.gain[r.node] = r.threshold, r.missing_left, r.value, r.gain
    return Booster(tuple(features), prediction, base, trees)


def split_counts(spark: SparkSession, model: Booster) -> DataFrame:
    """Per feature of the model: splits made on it and their total gain."""
    splits = node_table(spark, model).where("feature is not null").groupBy("feature").agg(F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    names = spark.createDataFrame([(f,) for f in model.features], "feature string")
    zero = {"splits": F.coalesce("splits", F.lit(0)).cast("long"), "gain": F.coalesce("gain", F.lit(0.0))}
    return names.join(splits, "feature", "left").withColumns(zero)


def feature_importance(spark: SparkSession, model: Booster, k: int | None = 10) -> DataFrame:
    """Features by the number of splits made on them, the larger gain first on a tie."""
    ranked = split_counts(spark, model).orderBy(F.desc("splits"), F.desc("gain"), "feature")
    return ranked.limit(k) if k is not None else ranked


def save_model(spark: SparkSession, model: Booster, path: str) -> None:
    """Node table, what else the model needs, and its feature ranking."""
    node_table(spark, model).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    about = json.dumps({"features": model.features, "prediction": model.prediction, "base": model.base})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    feature_importance(spark, model, None).coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_model(spark: SparkSession, path: str) -> tuple[Booster, DataFrame]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    model = model_of(spark.read.schema(NODES).parquet(f"{path}/nodes"), about["features"], about["prediction"], about["base"])
    return model, spark.read.schema("feature string, splits long, gain double").json(f"{path}/features")
