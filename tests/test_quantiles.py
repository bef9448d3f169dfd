import numpy as np
import pandas as pd
import pytest

from faregrid.plans.thresholds import attach, exact_quantiles, value_count_quantile

RNG = np.random.default_rng(7)
SAMPLES = {
    "normal": RNG.normal(size=4001),
    "heavy tail": RNG.pareto(0.7, size=3000),
    "a third on one value": np.concatenate([np.full(1500, 3.25), RNG.uniform(0, 10, 3000)]),
    "few values": RNG.integers(0, 4, 2500).astype(float),
    "constant": np.full(77, 1.5),
    "single": np.array([2.0]),
    "negative": -RNG.exponential(size=999),
}


@pytest.mark.parametrize("accuracy", [10_000, 4])
@pytest.mark.parametrize("name", list(SAMPLES))
def test_equals_numpy(spark, name, accuracy):
    values = SAMPLES[name]
    probs = {"p0": 0.0, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(5)
    got = exact_quantiles(df, {k: ("x", p) for k, p in probs.items()}, accuracy=accuracy).first()
    for key, p in probs.items():
        assert got[key] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_groups_with_one_hot_key(spark):
    frame = pd.DataFrame({"g": ["hot"] * 3000 + ["b"] * 40 + ["c"], "x": RNG.normal(size=3041)})
    df = spark.createDataFrame(frame).repartition(6)
    got = {r.g: r for r in exact_quantiles(df, {"lo": ("x", 0.05), "hi": ("x", 0.95)}, ["g"], accuracy=50).collect()}
    want = frame.groupby("g")["x"].quantile([0.05, 0.95]).unstack()
    assert set(got) == set(want.index)
    for g in got:
        assert got[g].lo == pytest.approx(want.loc[g, 0.05])
        assert got[g].hi == pytest.approx(want.loc[g, 0.95])


def test_two_columns_with_nulls(spark):
    frame = pd.DataFrame({"x": RNG.normal(size=500), "y": RNG.normal(size=500)})
    frame.loc[::3, "y"] = None
    df = spark.createDataFrame(frame).selectExpr("x", "nanvl(y, null) as y")
    got = exact_quantiles(df, {"mx": ("x", 0.5), "my": ("y", 0.5), "qy": ("y", 0.9)}).first()
    assert got.mx == pytest.approx(frame.x.median())
    assert got.my == pytest.approx(frame.y.median())
    assert got.qy == pytest.approx(frame.y.quantile(0.9))


def test_empty_input_gives_nulls(spark):
    df = spark.createDataFrame([], "x double")
    assert exact_quantiles(df, {"m": ("x", 0.5)}).first().m is None


def test_value_counts(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,), (None,)], "x double")
    assert value_count_quantile(df, "x", 0.5).first().q == 2.0


def test_attach_without_rows_gives_nulls(spark):
    df = spark.range(2)
    none = spark.createDataFrame([], "cut double")
    assert [r.cut for r in attach(df, none).collect()] == [None, None]
