"""Codes by parts on metric trees, against plain nearest entries."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faregrid.llm import part_codes as pc

SCHEMA = "vec_id long, embedding array<double>, label string, code string, error long, parts int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, np.floor(256 * np.array(v, float)).astype(int), x) for i, v, x in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    values = np.array([v for _, v, _ in kept])
    cut = pc.bounds(values.shape[1], parts)
    books, codes, errors = [], [], np.zeros(len(kept), int)
    for a, b in zip(cut, cut[1:]):
        points, book = values[:, a:b], values[:entries, a:b].copy()
        for turn in range(rounds + 1):
            far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
            best = far.argmin(axis=1)
            for e in range(len(book) if turn < rounds else 0):
                if (best == e).any():
                    book[e] = points[best == e].sum(axis=0) // (best == e).sum()
        books.append(book)
        codes.append(best)
        errors += far.min(axis=1)
    by_label: dict = {}
    for (_, _, x), e in zip(kept, errors):
        by_label[x] = by_label.get(x, 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    texts = ["".join(f"{c[n]:02x}" for c in codes) for n in range(len(kept))]
    return [(i, t, int(e), by_label[x], digest) for (i, _, x), t, e in zip(kept, texts, errors)]


def vectors(n, dims=32, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    rows = [(i, (centres[i % 5] + rng.normal(size=dims) * 0.2).tolist(), f"l{i % 3}") for i in range(n)]
    copies = [(n + i, rows[7][1], None) for i in range(n // 3)]
    odd = [(5000, None, "a"), (5001, [], "a"), (5002, [None] + [0.0] * (dims - 1), "a"), (5003, [float("nan")] * dims, "a"),
           (5004, [float("inf")] + [0.0] * (dims - 1), "a"), (5005, [0.0] * dims, "a"), (3, rows[4][1], "twice"), (None, rows[5][1], None)]
    return rows + copies + odd


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v, x) for i, v, x in rows], "vec_id long, embedding array<double>, label string")
    return df.withColumns({c: F.lit("x") for c in ("code", "error", "ids", "labels", "vector", "points")})


@pytest.mark.parametrize(("dims", "n", "blocks"), [(32, 400, 64), (32, 60, 4096), (35, 200, 100), (16, 300, 50)])
def test_codes(spark, monkeypatch, dims, n, blocks):
    monkeypatch.setattr(pc, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(pc, "LEAF", 8)
    rows = vectors(n, dims)
    got = [tuple(r) for r in pc.codes_with_label_errors(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_few_entries_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pc, "BROADCAST_IDS", 0)
    rows = vectors(150, 8)
    got = [tuple(r) for r in pc.codes_with_label_errors(frame(spark, rows), parts=2, entries=5, rounds=4).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, 2, 5, 4), key=str)


def test_other_lengths_and_large_components(spark):
    rows = [(1, [1e300] * 16, "a"), (2, [-1e300] * 16, "a"), (3, [1.0] * 15, "a"), (4, [0.5] * 16, None)]
    got = {r["vec_id"]: r for r in pc.codes_with_label_errors(frame(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 4] and {r["error"] for r in got.values()} == {0}


def test_empty(spark):
    assert pc.codes_with_label_errors(frame(spark, vectors(9)).where("vec_id < 0")).count() == 0
    assert pc.codes_with_label_errors(frame(spark, vectors(9)).where("vec_id between 5000 and 5004")).count() == 0


POINTS = st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=60)


@given(POINTS, st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=12), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_trees_find_the_nearest_entry(points, entries, leaf):
    points, entries = np.array(points), np.array(entries)
    tree = pc.metric_tree(points, leaf)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    mine = points[tree.order]
    for ball in range(len(tree.low)):
        inside = mine[tree.low[ball] : tree.high[ball]]
        assert (inside.sum(axis=0) == tree.sums[ball]).all()
        assert np.sqrt(((inside - tree.centre(ball)) ** 2).sum(axis=1)).max() <= tree.radius[ball] + 1e-9
    found = np.full(len(points), -1)
    for low, high, entry, _ in pc.owned(tree, mine, entries):
        found[low:high] = entry
    want = ((mine[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert found.tolist() == want.tolist()
