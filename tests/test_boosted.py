"""Boosted trees against a plain numpy version, and what their settings promise."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from faregrid.models import boosted
from faregrid.models.boosted import BoostParams

PLAIN = BoostParams(trees=6, depth=3, subsample=1.0, column_share=1.0, min_child_weight=4, l1=3.0, l2=2.0, gamma=0.5)


def made(n=400, seed=5):
    """Rows of two numbers with gaps, a small whole number and a label."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n).round(2), rng.normal(size=n).round(1), rng.integers(0, 5, n)
    label = 10 + 4 * (a > 0.3) - 3 * (b < -0.2) * (c > 2) + rng.normal(size=n)
    a[rng.random(n) < 0.1] = np.nan
    label[np.isnan(a)] += 5
    return a, b, c, label.round(3)


def frame(spark, rows):
    a, b, c, label = rows
    data = [(None if np.isnan(x) else float(x), float(y), int(z), float(w), i % 4 == 0) for i, (x, y, z, w) in enumerate(zip(a, b, c, label))]
    return spark.createDataFrame(data, "a double, b double, c int, y double, held boolean").repartition(5)


def plain_boost(values, label, p):
    """Trees by listing every cut of every feature; predictions on the training rows."""
    shrink = lambda g: np.sign(g) * max(abs(g) - p.l1, 0)
    worth = lambda g: shrink(g.sum()) ** 2 / (len(g) + p.l2)
    margin = np.full(len(label), label.mean())

    def grow(rows, depth):
        g = (margin - label)[rows]
        best = None
        for f in range(values.shape[1]) if depth else ():
            x = values[rows, f]
            for cut in np.unique(x[~np.isnan(x)])[:]:
                for missing in (True, False):
                    left = np.where(np.isnan(x), missing, x <= cut)
                    if min(left.sum(), (~left).sum()) < p.min_child_weight:
                        continue
                    gain = 0.5 * (worth(g[left]) + worth(g[~left]) - worth(g)) - p.gamma
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = gain, left
        if best is None:
            step[rows] = -p.learning_rate * shrink(g.sum()) / (len(g) + p.l2)
        else:
            grow(rows[best[1]], depth - 1)
            grow(rows[~best[1]], depth - 1)

    for _ in range(p.trees):
        step = np.zeros(len(label))
        grow(np.arange(len(label)), p.depth)
        margin = margin + step
    return margin


@pytest.mark.parametrize("p", [PLAIN, replace(PLAIN, l1=0.0, l2=0.0, gamma=0.0, min_child_weight=1), replace(PLAIN, depth=1, trees=20)])
def test_equals_plain_boosting(spark, p):
    rows = made(250)
    df = frame(spark, rows)
    model = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", p)
    got = boosted.score(model, df).toPandas()
    # In the frame's order, which is another than that of the rows.
    want = plain_boost(got[["a", "b", "c"]].to_numpy(float), got["y"].to_numpy(), p)
    assert np.allclose(got["pred"], want, atol=1e-6)


def test_order_of_rows_and_margins_written_between_change_nothing(spark, monkeypatch):
    df = frame(spark, made())
    p = replace(PLAIN, trees=7)
    first = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", p)
    monkeypatch.setattr(boosted, "REWRITE", 2)
    monkeypatch.setattr(boosted, "FEW_TASKS", 0)
    monkeypatch.setattr(boosted, "BLOCK_ROWS", 70)
    second = boosted.fit_regressor(df.orderBy(F.desc("y")), ["a", "b", "c"], "y", "pred", p)
    for one, other in zip(first.trees, second.trees, strict=True):
        assert one.feature.tolist() == other.feature.tolist() and np.allclose(one.value, other.value)


def test_validation_keeps_the_best_step(spark):
    df = frame(spark, made(900))
    p = BoostParams(trees=300, depth=4, learning_rate=0.5, l1=0.0, l2=0.0, min_child_weight=1, patience=5)
    model = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", p, "held")
    errors = []
    held = df.where("held").toPandas()
    for n in range(len(model.trees) + 1):
        cut = boosted.Booster(model.features, "pred", model.base, model.trees[:n])
        errors.append(((cut.predict(held[["a", "b", "c"]].to_numpy(float)) - held["y"]) ** 2).mean())
    assert 0 < len(model.trees) < 300 and int(np.argmin(errors)) == len(model.trees)


def test_penalties_shrink(spark):
    df = frame(spark, made())
    base = replace(PLAIN, trees=1)
    spread = [np.abs(boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", replace(base, l1=x, l2=y)).trees[0].value).max() for x, y in ((0, 0), (30, 0), (30, 90))]
    assert spread[0] > spread[1] > spread[2] > 0
    assert boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", replace(base, l1=1e6)).trees == []


def test_rows_are_drawn_by_number_alone():
    whole = boosted.drawn(0, 10_000, 42, 3, 0.8)
    parts = np.concatenate([boosted.drawn(i, 1000, 42, 3, 0.8) for i in range(0, 10_000, 1000)])
    assert (whole == parts).all() and 0.78 < whole.mean() < 0.82
    assert (whole != boosted.drawn(0, 10_000, 42, 4, 0.8)).any()


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1.0, False), (1.0, float("nan"), None, False), (2.0, None, float("nan"), False)], "a double, b double, y double, held boolean")
    model = boosted.fit_regressor(df, ["a", "b"], "y", "pred", PLAIN, "held")
    assert [r.pred for r in boosted.score(model, df).collect()] == [1.0] * 3
    none = boosted.fit_regressor(df.where("a > 5"), ["a", "b"], "y", "pred", PLAIN)
    assert none.trees == [] and [r.pred for r in boosted.score(none, df).collect()] == [0.0] * 3
    same = spark.createDataFrame([(1.0, 2.0)] * 9, "a double, y double")
    assert [r.pred for r in boosted.score(boosted.fit_regressor(same, ["a"], "y", "pred", PLAIN), same).collect()] == [2.0] * 9


def test_split_counts_are_a_walk_of_the_trees(spark, tmp_path):
    df = frame(spark, made())
    model = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", PLAIN)
    walked = {name: 0 for name in model.features}
    for tree in model.trees:
        for f in tree.feature:
            if f >= 0:
                walked[model.features[f]] += 1
    ranked = boosted.feature_importance(spark, model, None).collect()
    assert {r.feature: r.splits for r in ranked} == walked
    assert [r.splits for r in ranked] == sorted(walked.values(), reverse=True)
    boosted.save_model(spark, model, str(tmp_path))
    loaded, _ = boosted.load_model(spark, str(tmp_path))
    assert {r.feature: r.splits for r in boosted.split_counts(spark, loaded).collect()} == walked
    values = df.toPandas()[["a", "b", "c"]].to_numpy(float)
    assert (loaded.predict(values) == model.predict(values)).all()


def test_penalties_per_row():
    half = boosted.for_rows(boosted.DEMAND, boosted.PUBLISHED_ROWS // 2)
    assert (round(half.l1), round(half.l2)) == (100, 100) and half.depth == boosted.DEMAND.depth
    assert boosted.for_rows(boosted.REVENUE, 10**9) == boosted.REVENUE


def test_many_trees_take_few_jobs(spark):
    df = frame(spark, made())
    spark.sparkContext.setJobGroup("few-jobs", "")
    model = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", replace(PLAIN, trees=40, gamma=0.0, l1=0.0))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 40 and 0 < len(jobs) < 40


@pytest.mark.parametrize("validation", [None, "held"])
def test_trees_of_one_task_equal_those_of_a_job_a_level(spark, monkeypatch, validation):
    df = frame(spark, made(900)).coalesce(1).sortWithinPartitions("y")
    p = BoostParams(trees=11, depth=4, learning_rate=0.5, l1=0.0, l2=0.0, min_child_weight=1, patience=3, bins=20)
    monkeypatch.setattr(boosted, "TREES_A_JOB", 4)
    held = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", p, validation)
    for name, value in (("HELD_ROWS", 0), ("REWRITE", 2), ("FEW_TASKS", 0)):
        monkeypatch.setattr(boosted, name, value)
    by_jobs = boosted.fit_regressor(df, ["a", "b", "c"], "y", "pred", p, validation)
    assert held.trees and held.base == by_jobs.base
    for one, other in zip(held.trees, by_jobs.trees, strict=True):
        for name in ("feature", "bin", "threshold", "missing_left", "value", "gain"):
            assert (getattr(one, name) == getattr(other, name)).all()
