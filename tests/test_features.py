"""Windows against pandas, over block borders and a hot zone."""

import time
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faregrid.operators import features, splits
from faregrid.params import DEFAULTS
from faregrid.plans import positions
from faregrid.storage import staged

RNG = np.random.default_rng(3)


def make_series():
    """One zone with most of the rows and gaps, others short."""
    parts = []
    for zone, n in ((1, 5200), (2, 300), (3, 40), (4, 6), (5, 1)):
        bins = np.sort(RNG.choice(n * 3, size=n, replace=False))
        parts.append(pd.DataFrame({"cluster_id": zone, "time_bin": bins, "demand": RNG.integers(1, 60, n)}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame():
    return make_series()


@pytest.fixture(scope="module")
def series(spark, frame):
    df = spark.createDataFrame(frame.sample(frac=1, random_state=1))
    return df.selectExpr("cast(cluster_id as int) cluster_id", "cast(time_bin as int) time_bin", "demand").cache()


def ordered(df):
    return df.toPandas().sort_values(["cluster_id", "time_bin"]).reset_index(drop=True)


def test_positions(series, frame):
    got = ordered(positions.with_positions(series, ["cluster_id"], "time_bin", width=100))
    want = frame.groupby("cluster_id").cumcount() + 1
    assert (got["pos"].values == want.values).all()
    assert (got["n_rows"].values == frame.groupby("cluster_id")["demand"].transform("size").values).all()


@pytest.mark.parametrize("alpha", [0.3, 0.05, 0.9])
def test_windows_equal_pandas(series, frame, alpha):
    p = replace(DEFAULTS, ema_alpha=alpha)
    got = ordered(features.add_features(series, p=p))
    assert len(got) == len(frame)
    demand = frame.groupby("cluster_id")["demand"]
    for k in range(1, 6):
        np.testing.assert_array_equal(got[f"ft_{k}"].astype(float), demand.shift(k))
    for w in (7, 30):
        want = demand.transform(lambda x: x.rolling(w, min_periods=1).mean().shift(1))
        np.testing.assert_allclose(got[f"rolling_avg_{w}"], want, rtol=1e-12)
    want = demand.transform(lambda x: x.ewm(alpha=alpha, adjust=False).mean().shift(1))
    np.testing.assert_allclose(got["exp_avg_recursive"], want, rtol=1e-10)


def test_average_starts_again_after_the_drop(series, frame):
    got = ordered(features.main_features(series))
    kept = frame[frame.groupby("cluster_id").cumcount() >= 5].copy()
    kept["want"] = kept.groupby("cluster_id")["demand"].transform(lambda x: x.ewm(alpha=0.3).mean().shift(1))
    assert len(got) == len(kept)
    np.testing.assert_allclose(got["exp_avg"], kept["want"], rtol=1e-10)
    assert got["exp_avg"].isna().sum() == kept["cluster_id"].nunique()


def test_no_row_sees_itself_or_later(spark, series):
    """Raising one demand changes features of later rows only."""
    changed = series.selectExpr(
        "cluster_id", "time_bin", "if(cluster_id = 2 and time_bin >= 300, demand + 1000, demand) as demand"
    )
    before = ordered(features.add_features(series).where("cluster_id = 2 and time_bin <= 300"))
    after = ordered(features.add_features(changed).where("cluster_id = 2 and time_bin <= 300"))
    columns = ["ft_1", "ft_5", "rolling_avg_7", "rolling_avg_30", "exp_avg", "exp_avg_recursive"]
    pd.testing.assert_frame_equal(before[columns], after[columns])


def test_no_block_holds_a_whole_hot_zone(series):
    placed = positions.in_blocks(positions.with_positions(series, ["cluster_id"], "time_bin"), 500, 110)
    largest = placed.groupBy("cluster_id", "_block").count().agg({"count": "max"}).first()[0]
    assert largest <= 610


def test_halo_must_fit(series):
    with pytest.raises(ValueError):
        positions.in_blocks(series.withColumnRenamed("time_bin", "pos"), 10, 11)


def test_global_split(series, frame):
    got = splits.global_split(series).toPandas().sort_values(["time_bin", "cluster_id"]).reset_index(drop=True)
    n = len(frame)
    first, second = int(n * 0.7), int(n * (0.7 + 0.15))
    want = ["train"] * first + ["validation"] * (second - first) + ["test"] * (n - second)
    assert got["split"].tolist() == want


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_global_split_of_few_rows(spark, n):
    df = spark.createDataFrame([(z, 0) for z in range(n)], "cluster_id int, time_bin int")
    got = [r.split for r in splits.global_split(df).orderBy("cluster_id").collect()]
    first, second = int(n * 0.7), int(n * (0.7 + 0.15))
    assert got == ["train"] * first + ["validation"] * (second - first) + ["test"] * (n - second)


def test_zone_split(series, frame):
    got = ordered(splits.zone_split(series))
    for zone, part in got.groupby("cluster_id"):
        n = len(part)
        sizes = part["split"].value_counts().to_dict()
        assert sizes.get("train", 0) == int(n * 0.7)
        assert sizes.get("train", 0) + sizes.get("validation", 0) == int(n * (0.7 + 0.15))


def test_running_offsets(spark):
    rows = [(int(o), int(s)) for o, s in zip(range(0, 9000, 7), RNG.integers(1, 9, 1286))]
    df = spark.createDataFrame(rows, "o int, s int")
    got = [r.before for r in positions.running_offsets(df, "o", "s", width=64).orderBy("o").collect()]
    sizes = [s for _, s in rows]
    assert got == list(np.concatenate([[0], np.cumsum(sizes)[:-1]]))


@pytest.mark.parametrize(("alpha", "windows"), [(0.3, (144, 1008)), (0.3, (1008, 4320)), (0.01, (7,)), (0.99, (7, 300)), (0.5, ())])
def test_long_windows_and_any_alpha(series, frame, alpha, windows):
    p = replace(DEFAULTS, ema_alpha=alpha, rolling_windows=windows)
    got = ordered(features.add_features(series, p=p))
    demand = frame.groupby("cluster_id")["demand"]
    want = demand.transform(lambda x: x.ewm(alpha=alpha, adjust=False).mean().shift(1))
    np.testing.assert_allclose(got["exp_avg_recursive"], want, rtol=1e-9)
    assert np.isfinite(got["exp_avg"][got["pos"] > 6]).all()
    for w in windows:
        want = demand.transform(lambda x, w=w: x.rolling(w, min_periods=1).mean().shift(1))
        np.testing.assert_allclose(got[f"rolling_avg_{w}"], want, rtol=1e-12)


@pytest.mark.parametrize("alpha", [0.0, 1.0, -0.5, 2.0])
def test_alpha_outside_its_range(series, alpha):
    with pytest.raises(ValueError):
        features.add_features(series, p=replace(DEFAULTS, ema_alpha=alpha))


def test_long_windows_of_gaps_fractions_and_odd_values(spark):
    rng = np.random.default_rng(11)
    n = 3000
    x = np.round(rng.normal(1000, 300, n), 3)
    x[rng.random(n) < 0.1] = np.nan
    data = [(1, i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [(2, i, float("nan") if i == 40 else float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "z int, b long, y double")
    p = replace(DEFAULTS, n_lags=1, rolling_windows=(7, 30, 1500), ema_alpha=0.3)
    got = features.add_features(df, "z", "b", "y", p).orderBy("z", "b").toPandas()
    one, two = got[got.z == 1].reset_index(), got[got.z == 2].reset_index()
    for w in p.rolling_windows:
        want = pd.Series(x).shift(1).rolling(w, min_periods=1).mean()
        assert np.allclose(one[f"rolling_avg_{w}"], want, rtol=1e-9, equal_nan=True)
    assert np.isnan(two["rolling_avg_7"][41:48]).all() and two["rolling_avg_7"][48] == np.mean(range(41, 48))
    assert np.isnan(two["rolling_avg_30"][70]) and two["rolling_avg_30"][71] == np.mean(range(41, 71))


def test_cost_does_not_grow_with_the_window(spark):
    df = spark.range(200_000).select((F.col("id") % 4).cast("int").alias("z"), F.floor(F.col("id") / 4).alias("b"), (F.col("id") % 97).alias("y"))
    df = staged(df, "long-series")

    def seconds(windows):
        start = time.perf_counter()
        features.add_features(df, "z", "b", "y", replace(DEFAULTS, rolling_windows=windows)).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds((7, 30))
    short, long = min(seconds((7, 30)) for _ in range(2)), min(seconds((7, 4320)) for _ in range(2))
    assert long < 3 * short + 2
    print(short, long)
