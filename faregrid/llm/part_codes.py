"""Codes of vectors by parts, with codebooks trained on anchors-hierarchy metric trees.

Vectors become integers and are cut into parts. For each block of rows and each part the points
are arranged once in a metric tree, built from the middle out: about as many anchors as the root
of the points take the points nearest to them, anchors are merged pair by pair up to one root, and
anchors with many points are divided in the same way. Each ball caches its count, sum and radius.
Blocks and trees are written, so a round of training reads them and builds nothing.

A round walks each tree with the list of entries that may still be nearest to some point of the
ball. An entry leaves the list where another is nearer to the whole ball, children inherit what is
left, and where one entry is left it owns the ball: cached count and sum stand for its points. Only
balls without owner at the leaves are measured point by point, in integers. Tasks return sums and
counts per entry, added up by part, entry and position; the driver sees a codebook, whose size
the parameters fix.

Defined results: rows whose vector is null, empty or holds null or non-finite components are left
out, as are vectors of another length than the first kept row's. Components whose integer exceeds
2**26 count as that, so squared distances stay exact. If the length isn't a multiple of the parts,
the last parts are shorter. Ties of ids in the first codebook are ordered by the vectors; fewer rows
than entries give fewer entries. Equal entries stay, and the lowest index gets their points. Rows that
repeat an id are coded each on its own. Other columns take no part. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm.common import BROADCAST_IDS, folded, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LIMIT = 1 << 26
BLOCK_ROWS = 4096
LEAF = 128
Codebook = list[np.ndarray]  # per part, entries x components


@dataclass
class Tree:
    """Balls over points in leaf order: each is a run of points with two children, or a leaf (-1)."""

    order: np.ndarray  # row of each point
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray  # balls x components

    def centre(self, ball: int) -> np.ndarray:
        return self.sums[ball] / (self.high[ball] - self.low[ball])


def anchored(points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of up to ``count`` anchors, and for each point the anchor that owns it.

    Each new anchor is the point farthest from its owner, and takes the points nearer to it than to
    theirs. An anchor at twice its radius or more has none to lose; a radius only shrinks, so its
    first value is a bound.
    """
    owner = np.zeros(len(points), np.int64)
    rows = [0]
    near = ((points - points[0]) ** 2).sum(axis=1)
    reach = np.zeros(count)
    reach[0] = near.max()
    while len(rows) < count:
        new = int(near.argmax())
        if not near[new]:
            break
        apart = ((points[rows] - points[new]) ** 2).sum(axis=1)
        losing = apart < 4 * reach[: len(rows)]
        mine = np.flatnonzero(losing[owner])
        to_new = ((points[mine] - points[new]) ** 2).sum(axis=1)
        stolen = to_new < near[mine]
        mine, to_new = mine[stolen], to_new[stolen]
        owner[mine], near[mine] = len(rows), to_new
        reach[len(rows)] = to_new.max()
        rows.append(new)
    return np.array(rows), owner


class _Builder:
    """Balls of one tree, children before parents."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points, self.leaf = points, leaf
        self.children: list[tuple[int, int]] = []
        self.members: list[np.ndarray] = []  # of leaves
        self.sizes: list[int] = []
        self.sums: list[np.ndarray] = []
        self.radii: list[float] = []

    def centre(self, ball: int) -> np.ndarray:
        return self.sums[ball] / self.sizes[ball]

    def _add(self, children: tuple[int, int], members: np.ndarray, size: int, total: np.ndarray) -> int:
        for column, value in ((self.children, children), (self.members, members), (self.sizes, size), (self.sums, total)):
            column.append(value)
        return len(self.children) - 1

    def _leaf(self, members: np.ndarray) -> int:
        inside = self.points[members]
        ball = self._add((-1, -1), members, len(members), inside.sum(axis=0))
        self.radii.append(float(np.sqrt(((inside - self.centre(ball)) ** 2).sum(axis=1).max())))
        return ball

    def _common(self, left: int, right: int) -> int:
        """The ball around two others; its radius is a bound."""
        ball = self._add((left, right), _NONE, self.sizes[left] + self.sizes[right], self.sums[left] + self.sums[right])
        gaps = [np.sqrt(((self.centre(ball) - self.centre(x)) ** 2).sum()) + self.radii[x] for x in (left, right)]
        self.radii.append(float(max(gaps)))
        return ball

    def build(self, members: np.ndarray) -> int:
        """Root of a tree over ``members``, from the middle out."""
        if len(members) <= self.leaf:
            return self._leaf(members)
        rows, owner = anchored(self.points[members], int(np.ceil(np.sqrt(len(members)))))
        if len(rows) == 1:  # all points are equal
            return self._leaf(members)
        order = np.argsort(owner, kind="stable")
        runs = np.split(members[order], np.cumsum(np.bincount(owner, minlength=len(rows)))[:-1])
        return self._merged([self.build(run) for run in runs])

    def _merged(self, balls: list[int]) -> int:
        """One root: of all pairs, the two whose common ball is smallest are merged first."""
        n = len(balls)
        at = list(balls)
        centre = np.array([self.centre(b) for b in balls])
        radius = np.array([self.radii[b] for b in balls])
        apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        size = np.maximum((apart + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
        gone = np.full(n, np.inf)
        size[np.diag_indices(n)] = np.inf
        for _ in range(n - 1):
            i, j = sorted(divmod(int(size.argmin()), n))
            at[i] = self._common(at[i], at[j])
            radius[i], centre[i] = self.radii[at[i]], self.centre(at[i])
            gaps = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
            fresh = np.maximum((gaps + radius + radius[i]) / 2, np.maximum(radius, radius[i]))
            fresh[np.isinf(size[i])] = np.inf  # itself, and what was merged before
            size[i, :] = size[:, i] = fresh
            size[j, :] = size[:, j] = gone
        return at[0]


_NONE = np.empty(0, np.int64)


def metric_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Tree over integer points; the last ball is the root."""
    builder = _Builder(points, leaf)
    builder.build(np.arange(len(points)))
    n = len(builder.children)
    low, placed, spots, todo = np.zeros(n, np.int64), 0, [], [n - 1]
    while todo:
        ball = todo.pop()
        low[ball] = placed
        left, right = builder.children[ball]
        if left < 0:
            spots.append(builder.members[ball])
            placed += builder.sizes[ball]
        else:
            todo += [right, left]
    children = np.array(builder.children)
    high = low + np.array(builder.sizes)
    return Tree(np.concatenate(spots), low, high, children[:, 0], children[:, 1], np.array(builder.radii), np.array(builder.sums))


def owned(tree: Tree, points: np.ndarray, entries: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, int]]:
    """(low, high, entries of these points, ball) of runs of points in leaf order; a number where one entry owns a ball."""
    first = np.sort(np.unique(entries, axis=0, return_index=True)[1])  # equal entries: the lowest index
    todo = [(len(tree.low) - 1, first)]
    while todo:
        ball, listed = todo.pop()
        low, high = int(tree.low[ball]), int(tree.high[ball])
        if len(listed) > 1:
            known = entries[listed]
            far = ((known - tree.centre(ball)) ** 2).sum(axis=1)
            best = int(far.argmin())
            reach = 2 * tree.radius[ball] * np.sqrt(((known - known[best]) ** 2).sum(axis=1))
            # Rounding may keep an entry too long, and never drops one that ties.
            listed = listed[far - far[best] <= reach + 1e-9 * (far + reach + 1)]
        if len(listed) == 1:
            yield low, high, int(listed[0]), ball
        elif tree.left[ball] < 0:
            gaps = ((points[low:high, None, :] - entries[listed][None]) ** 2).sum(axis=2)
            yield low, high, listed[gaps.argmin(axis=1)], ball
        else:
            todo += [(int(tree.right[ball]), listed), (int(tree.left[ball]), listed)]


def bounds(dims: int, parts: int) -> list[int]:
    """Component at which each part starts, and the end; the first parts take what doesn't divide."""
    return [0, *np.cumsum([len(x) for x in np.array_split(np.arange(dims), parts)]).tolist()]


def _blocks(parts: int, dims: int, rows: int, leaf: int):
    """Rows of a task, ``rows`` at a time, with a tree per part."""
    cut = bounds(dims, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                ids, labels, flat = (batch.column(i).slice(at, rows) for i in range(3))
                values = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)
                values = np.clip(np.floor(SCALE * np.clip(values, -LIMIT, LIMIT)), -LIMIT, LIMIT).astype(np.int64)
                trees = [metric_tree(values[:, a:b], leaf) for a, b in zip(cut, cut[1:])]
                points = np.concatenate([values[t.order, a:b].ravel() for t, a, b in zip(trees, cut, cut[1:])])
                numbers = [np.concatenate([getattr(t, name).ravel() for t in trees]) for name in ("order", "low", "high", "left", "right")]
                columns = [
                    pa.ListArray.from_arrays([0, len(ids)], ids),
                    pa.ListArray.from_arrays([0, len(labels)], labels),
                    pa.array([[len(t.low) for t in trees]], pa.list_(pa.int32())),
                    pa.array([points.astype(np.int32)], pa.list_(pa.int32())),
                    *(pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in numbers),
                    pa.array([np.concatenate([t.radius for t in trees])], pa.list_(pa.float64())),
                    pa.array([np.concatenate([t.sums.ravel() for t in trees])], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, _BLOCK_NAMES)

    return run


_BLOCK_NAMES = ["ids", "labels", "balls", "points", "order", "low", "high", "left", "right", "radius", "sums"]


def _trees(batch: pa.RecordBatch, row: int, dims: int, parts: int) -> Iterator[tuple[Tree, np.ndarray]]:
    """Per part the tree of a block and its points in leaf order."""
    block = {name: batch.column(name).slice(row, 1).flatten().to_numpy(zero_copy_only=False) for name in _BLOCK_NAMES[2:]}
    cut = bounds(dims, parts)
    n = len(block["points"]) // dims
    ball = np.concatenate(([0], np.cumsum(block["balls"])))
    total = np.concatenate(([0], np.cumsum(block["balls"] * np.diff(cut))))
    for part, (a, b) in enumerate(zip(cut, cut[1:])):
        fields = [block[x][ball[part] : ball[part + 1]] for x in ("low", "high", "left", "right", "radius")]
        sums = block["sums"][total[part] : total[part + 1]].reshape(-1, b - a)
        points = block["points"][n * a : n * b].reshape(n, b - a).astype(np.int64)
        yield Tree(block["order"][n * part : n * (part + 1)], *fields, sums), points


def _totals(codebooks: Codebook, dims: int):
    """(part, entry, place, count, total): what the entries of this task's blocks own, sent once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros_like(c) for c in codebooks]
        for batch in batches:
            for row in range(len(batch)):
                for part, (tree, points) in enumerate(_trees(batch, row, dims, len(codebooks))):
                    for low, high, entry, ball in owned(tree, points, codebooks[part]):
                        if isinstance(entry, int):
                            counts[part][entry] += high - low
                            sums[part][entry] += tree.sums[ball]
                        else:
                            np.add.at(counts[part], entry, 1)
                            np.add.at(sums[part], entry, points[low:high])
        for part, (count, total) in enumerate(zip(counts, sums)):
            entry, place = (x.ravel() for x in np.indices(total.shape))
            columns = [np.full(total.size, part), entry, place, count[entry], total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "place", "count", "total"])

    return run


def trained(blocks: DataFrame, codebooks: Codebook, dims: int) -> Codebook:
    """Codebooks after one round over the written ``blocks``. The driver sees one row per component of an entry."""
    found = blocks.mapInArrow(_totals(codebooks, dims), "part long, entry long, place long, count long, total long")
    added = found.groupBy("part", "entry", "place").agg(F.sum("count").alias("count"), F.sum("total").alias("total"))
    fresh = [c.copy() for c in codebooks]
    for part, entry, place, count, total in added.where("count > 0").collect():
        fresh[part][entry, place] = total // count
    return fresh


def _coded(codebooks: Codebook, dims: int, label_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, labels = (batch.column(name).slice(row, 1).flatten() for name in ("ids", "labels"))
                codes = np.zeros((len(ids), len(codebooks)), np.uint8)
                errors = np.zeros(len(ids), np.int64)
                for part, (tree, points) in enumerate(_trees(batch, row, dims, len(codebooks))):
                    mine = np.empty(len(ids), np.int64)
                    for low, high, entry, _ in owned(tree, points, codebooks[part]):
                        mine[low:high] = entry
                    codes[tree.order, part] = mine
                    errors[tree.order] += ((points - codebooks[part][mine]) ** 2).sum(axis=1)
                said = pa.array([x.tobytes().hex() for x in codes], pa.string())
                columns = [ids.cast(pa.int64()), labels.cast(label_type), said, pa.array(errors)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def digest(codebooks: Codebook) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def first_codebooks(rows: Sequence[Sequence[float]], parts: int) -> Codebook:
    values = np.clip(np.floor(SCALE * np.clip(np.array(rows, np.float64), -LIMIT, LIMIT)), -LIMIT, LIMIT).astype(np.int64)
    cut = bounds(values.shape[1], parts)
    return [values[:, a:b].copy() for a, b in zip(cut, cut[1:])]


def finite(vector: Column) -> Column:
    """Whether a vector has components, and each is a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def coded(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebook]:
    """(vec_id, label, code, error) of each vector that is kept, written, and the codebooks."""
    if entries > 256:
        raise ValueError("an entry's index has two hex digits")
    vector = F.col(vector_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector")).where(finite(vector))
    label_type = kept.schema["label"].dataType.simpleString()
    first = kept.orderBy(F.asc_nulls_last("vec_id"), F.col("vector")).select("vector").limit(entries).collect()
    dims = len(first[0][0]) if first else parts
    codebooks = first_codebooks([r[0] for r in first if len(r[0]) == dims], parts) if first else []
    schema = f"ids array<long>, labels array<{label_type}>, balls array<int>, points array<int>, order array<int>, low array<int>,"
    schema += " high array<int>, left array<int>, right array<int>, radius array<double>, sums array<long>"
    same = kept.where(F.size("vector") == dims)
    blocks = written(same.mapInArrow(_blocks(parts, dims, BLOCK_ROWS, LEAF), schema), "part-trees")
    for _ in range(rounds if first else 0):
        codebooks = trained(blocks, codebooks, dims)
    arrow = pa.schema([("x", _arrow_type(kept.schema["label"].dataType))]).field(0).type
    final = blocks.mapInArrow(_coded(codebooks, dims, arrow), f"vec_id long, label {label_type}, code string, error long")
    return written(final, "part-codes"), codebooks


def _arrow_type(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def codes_with_label_errors(vectors: DataFrame, **names) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    rows, codebooks = coded(vectors, **names)
    totals = folded(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    # A hot label meets one row, so adaptive execution can split it where labels are many.
    small = totals.count() <= BROADCAST_IDS // 4
    met = rows.alias("r").join((F.broadcast(totals) if small else totals).alias("t"), F.col("r.label").eqNullSafe(F.col("t.label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
