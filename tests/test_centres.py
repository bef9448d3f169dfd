"""Nearest of many centres, against plain distances."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from faregrid.operators import zones
from faregrid.storage import staged


def plain(points, centres):
    ids = np.array([c[0] for c in centres])
    order = np.argsort(ids, kind="stable")
    at = np.array([c[1:] for c in centres])[order]
    far = ((points[:, None] - at[None]) ** 2).sum(axis=2)
    return ids[order][far.argmin(axis=1)].tolist()


def frame(spark, points):
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "n int, pickup_latitude double, pickup_longitude double")


@pytest.mark.parametrize("kind", ["scattered", "clustered", "line", "equal", "lattice"])
def test_grid_finds_the_nearest(spark, kind):
    rng = np.random.default_rng(4)
    at = {
        "scattered": rng.uniform(-1, 1, (150, 2)) + (40.7, -73.9),
        "clustered": np.concatenate([rng.normal(0, 1e-4, (100, 2)), rng.normal(5, 1, (20, 2))]),
        "line": np.column_stack([np.full(60, 3.0), np.arange(60.0)]),
        "equal": np.zeros((50, 2)),
        "lattice": np.array([(i, j) for i in range(9) for j in range(9)], float),
    }[kind]
    centres = [(int(i), float(a), float(b)) for i, (a, b) in zip(rng.permutation(len(at)), at)]
    spread = at.max(axis=0) - at.min(axis=0) + 1e-3
    points = np.concatenate([at, rng.uniform(at.min(axis=0) - 2 * spread, at.max(axis=0) + 2 * spread, (800, 2)), (at[:-1] + at[1:]) / 2])
    got = zones.assign_nearest_centre(frame(spark, points), centres).orderBy("n").collect()
    assert [r.pickup_cluster for r in got] == plain(points, centres)


def test_odd_points(spark):
    centres = [(i, float(i), 0.0) for i in range(60)]
    rows = [(None, 1.0), (1.0, None), (float("nan"), 0.0), (1e300, 0.0), (-1e9, 5.0), (59.4, 0.0)]
    df = spark.createDataFrame(rows, "pickup_latitude double, pickup_longitude double")
    got = [r.pickup_cluster for r in zones.assign_nearest_centre(df, centres).collect()]
    assert got[:2] == [None, None] and got[4:] == [0, 59]


def test_cost_hardly_grows_with_the_centres(spark):
    rng = np.random.default_rng(4)
    df = staged(spark.range(400_000).select((F.rand(1) + 40).alias("pickup_latitude"), (F.rand(2) - 74).alias("pickup_longitude")), "points")

    def seconds(n):
        centres = [(i, float(a) + 40, float(b) - 74) for i, (a, b) in enumerate(rng.random((n, 2)))]
        start = time.perf_counter()
        zones.assign_nearest_centre(df, centres).groupBy("pickup_cluster").count().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(40), seconds(1000)
    few, many = min(seconds(40) for _ in range(2)), min(seconds(1000) for _ in range(2))
    print(few, many)
    assert many < 3 * few + 2


class TestBatches:
    POINTS = "pickup_latitude double, pickup_longitude double"

    def test_near_the_full_fit(self, spark):
        import numpy as np
        from dataclasses import replace

        from faregrid.params import DEFAULTS

        rng = np.random.default_rng(5)
        middles = rng.uniform(-1, 1, (25, 2))
        at = middles[rng.integers(0, 25, 40_000)] + 0.02 * rng.standard_normal((40_000, 2))
        points = spark.createDataFrame([tuple(map(float, x)) for x in at], self.POINTS).repartition(6)
        p = replace(DEFAULTS, n_clusters=25)
        steps = zones.fit_centres_in_batches(points, p, batch=256, steps=20)  # an eighth of the points
        assert [i for i, _, _ in steps] == list(range(25))
        inertia = [zones.squared_distances(points, c).first()["inertia"] for c in (steps, zones.fit_centres(points, p))]
        assert inertia[0] <= 1.02 * inertia[1]

    def test_odd_points(self, spark):
        frame = lambda rows: spark.createDataFrame(rows, self.POINTS)
        assert zones.fit_centres_in_batches(frame([])) == []
        assert zones.fit_centres_in_batches(frame([(None, 1.0), (float("nan"), 1.0)])) == []
        few = frame([(1.0, 2.0)] * 5 + [(3.0, 4.0), (None, 3.0)])
        assert sorted(c[1:] for c in zones.fit_centres_in_batches(few)) == [(1.0, 2.0), (3.0, 4.0)]

    def test_steps_are_running_means(self):
        import numpy as np

        x = np.array([[0.0, 0.0], [2.0, 0.0], [10.0, 0.0], [4.0, 0.0], [12.0, 0.0]])
        centres = zones._stepped(x, np.array([[1.0, 0.0], [11.0, 0.0], [99.0, 9.0]]), 2)
        assert np.allclose(centres, [[2.0, 0.0], [11.0, 0.0], [99.0, 9.0]])


def test_code_of_forty_centres_is_compiled(spark):
    """HotSpot leaves methods of more than 8,000 bytes to the interpreter."""
    import re

    centres = [(i, 40.5 + i % 7 * 0.05, -74.2 + i // 7 * 0.07) for i in range(40)]
    points = spark.range(10).select((F.lit(40.56) + F.rand(1)).alias("pickup_latitude"), (F.lit(-74.0) + F.rand(2)).alias("pickup_longitude"))
    df = zones.assign_nearest_centre(points, centres).withColumn("least", zones.least_squared(centres))
    said = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", said)]
    assert sizes and max(sizes) < 8000


def test_forty_centres_place_odd_points_as_generated_code_does(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    centres = [(50 - i, 40.5 + i % 7 * 0.05, -74.2 + i // 7 * 0.07) for i in range(40)]
    rows = [(nan, 1.0), (inf, -74.0), (None, 1.0), (1e300, 2.0), (40.7, None), (0.0, 0.0), (40.7, -inf), (40.525, -74.165), (40.55, -74.2)]
    df = spark.createDataFrame(rows, "pickup_latitude double, pickup_longitude double").coalesce(1)
    got = [r.pickup_cluster for r in zones.assign_nearest_centre(df, centres).collect()]
    monkeypatch.setattr(zones, "UNROLLED_CENTRES", 40)
    assert got == [r.pickup_cluster for r in zones.assign_nearest_centre(df, centres).collect()]
    assert got[0] == 11 and got[2] is None
