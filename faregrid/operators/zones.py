"""Zone ids, clustering, nearest centres and zone coordinates."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.params import DEFAULTS, Params
from faregrid.storage import staged

# Coordinates of zones without an entry of their own.
DEFAULT_LATITUDE = 40.7
DEFAULT_LONGITUDE = -73.9
# Approximate zone coordinates, as (first zone, last zone,
# latitude, latitude cycle, latitude step, longitude, longitude cycle,
# longitude step), with latitude + (zone % cycle) * step and
# longitude - (zone % cycle) * step.
ZONE_AREAS = (
    (1, 103, 40.730, 50, 0.006, -73.990, 20, 0.008),
    (104, 130, 40.820, 15, 0.008, -73.900, 10, 0.007),
    (131, 177, 40.650, 25, 0.007, -73.950, 18, 0.006),
    (178, 236, 40.700, 30, 0.006, -73.800, 22, 0.005),
    (237, 263, 40.580, 12, 0.007, -74.140, 8, 0.006),
)
# Centres compared in generated code; it grows with them, and a method of more than 8,000 bytes is never compiled.
UNROLLED_CENTRES = 12
# Up to so many centres, a point at no finite distance from any goes to the lowest id; with more, to none.
FAR_TO_LOWEST = 40


def assign_zone(df: DataFrame, column: str = "PULocationID") -> DataFrame:
    """The pickup location id is the zone."""
    return df.withColumn("cluster_id", F.col(column).cast("int"))


def count_zones(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("cluster_id").alias("n_zones"))


def busiest_zones(df: DataFrame, k: int = 5) -> DataFrame:
    """Zones with most rows; the lower id first on a tie."""
    return (
        df.where(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id")
        .agg(F.count(F.lit(1)).alias("trips"))
        .orderBy(F.desc("trips"), "cluster_id")
        .limit(k)
    )


def fit_centres(df: DataFrame, p: Params = DEFAULTS) -> list[tuple[int, float, float]]:
    """K-means centres of the pickup points, as (id, latitude, longitude)."""
    stages = [
        VectorAssembler(inputCols=["pickup_latitude", "pickup_longitude"], outputCol="_point", handleInvalid="skip"),
        KMeans(k=p.n_clusters, seed=p.seed, featuresCol="_point", predictionCol="_cluster"),
    ]
    model = Pipeline(stages=stages).fit(df.select("pickup_latitude", "pickup_longitude"))
    return [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.stages[-1].clusterCenters())]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds drawn far apart: each with odds of its squared distance to those before; fewer if points run out."""
    seeds = [x[rng.integers(len(x))]]
    far = ((x - seeds[0]) ** 2).sum(axis=1)
    while len(seeds) < k and far.max() > 0:
        seeds.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, ((x - seeds[-1]) ** 2).sum(axis=1))
    return np.array(seeds)


def _stepped(x: np.ndarray, centres: np.ndarray, batch: int) -> np.ndarray:
    """Centres after one pass over ``x`` in batches; each is the mean of all points it has been given so far."""
    given = np.zeros(len(centres))
    for at in range(0, len(x), batch):
        part = x[at : at + batch]
        own = _nearest(part, centres)
        count, sums = np.bincount(own, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, own, part)
        given += count
        moved = count > 0
        centres = centres.copy()
        centres[moved] += (sums[moved] - count[moved, None] * centres[moved]) / given[moved, None]
    return centres


def _settled(x: np.ndarray, centres: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Centres as the means of their points, until none moves, and the squared distances that are left."""
    for _ in range(rounds):
        own = _nearest(x, centres)
        count, sums = np.bincount(own, minlength=len(centres)), np.zeros_like(centres)
        np.add.at(sums, own, x)
        before, centres = centres, np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        if np.allclose(before, centres, rtol=0, atol=1e-9):
            break
    return centres, float(((x - centres[_nearest(x, centres)]) ** 2).sum())


def fit_centres_in_batches(
    df: DataFrame, p: Params = DEFAULTS, batch: int = 1024, steps: int = 64, starts: int = 10, passes: int = 2
) -> list[tuple[int, float, float]]:
    """Mini-batch K-means centres of the pickup points, as (id, latitude, longitude).

    Steps run on a sample of about ``batch * steps`` points, 1 MB whatever the table's size, from several starts.
    There they settle, and the start with the least squared distances goes on. Every point then takes part in
    ``passes`` rounds of means by grouped aggregation, which bring k rows to the driver each: so the table is read
    twice more than ``passes``, to count and to draw. Fewer distinct points than centres give that
    many centres, no points none. Points without a coordinate are left out.
    """
    lat, lon = "pickup_latitude", "pickup_longitude"
    usable = [F.col(c).isNotNull() & ~F.isnan(F.col(c)) for c in (lat, lon)]
    points = staged(df.select(F.col(lat).cast("double"), F.col(lon).cast("double")).where(usable[0] & usable[1]), "points")
    rows = points.count()
    if not rows:
        return []
    drawn = points.where(F.rand(p.seed) < min(1.0, batch * steps / rows)).toArrow()
    if not len(drawn):
        drawn = points.limit(1).toArrow()
    rng = np.random.default_rng(p.seed)
    x = rng.permutation(np.stack([drawn.column(c).to_numpy() for c in (lat, lon)], axis=1))
    middle = x.mean(axis=0)
    x -= middle  # distances lose no digits
    found = []
    for _ in range(starts):
        seeds = _spread_seeds(rng.permutation(x)[: 8 * batch], p.n_clusters, rng)
        found.append(_settled(x, _stepped(x, seeds, batch)))
    best = min(found, key=lambda f: f[1])[0] + middle
    named = [(i, float(a), float(b)) for i, (a, b) in enumerate(best)]
    for _ in range(passes):
        means = assign_nearest_centre(points, named).groupBy("pickup_cluster").agg(F.avg(lat), F.avg(lon))
        moved = {r[0]: (r[1], r[2]) for r in means.collect()}
        named = [(i, *moved.get(i, (a, b))) for i, a, b in named]
    return named


def squared_distances(df: DataFrame, centres: Sequence[tuple[int, float, float]]) -> DataFrame:
    """One row: ``inertia``, the sum of squared distances of all points to their nearest centre."""
    near = attach_centres(assign_nearest_centre(df, centres), centres)
    off = (F.col("pickup_latitude") - F.col("cluster_lat")) ** 2 + (F.col("pickup_longitude") - F.col("cluster_lon")) ** 2
    return near.agg(F.coalesce(F.sum(off), F.lit(0.0)).alias("inertia"))


def assign_nearest_centre(df: DataFrame, centres: Sequence[tuple[int, float, float]]) -> DataFrame:
    """Add ``pickup_cluster``, the id of the nearest centre (lower id on a tie).

    The centres are a small parameter, written into the expression: no join. Some ten of them are
    compared in generated code. More are looked up in a grid (:func:`centre_grid`), where a point meets only
    the few centres that can be nearest in its cell; points outside the grid are compared with all.
    """
    if not centres:
        raise ValueError("expected at least one centre")
    lat, lon = F.col("pickup_latitude"), F.col("pickup_longitude")

    def squared(c_lat, c_lon):
        return (lat - c_lat) * (lat - c_lat) + (lon - c_lon) * (lon - c_lon)

    if len(centres) <= UNROLLED_CENTRES:
        scored = [F.struct(squared(a, b).alias("d"), F.lit(int(i)).alias("id")) for i, a, b in centres]
        nearest = F.array_min(F.array(*scored))["id"]
    else:
        table = sorted((int(i), float(a), float(b)) for i, a, b in centres)
        far = table[0][0] if len(table) <= FAR_TO_LOWEST else None
        none = F.struct(F.lit(float("inf")).alias("d"), F.lit(far).cast("int").alias("id"))

        def closer(best, c):
            d = squared(c["a"], c["b"])
            return F.when(d < best["d"], F.struct(d.alias("d"), c["id"].alias("id"))).otherwise(best)

        def listed(numbers: list[int]) -> list[dict]:
            return [{"id": table[n][0], "a": table[n][1], "b": table[n][2]} for n in numbers]

        every = _constant(listed(range(len(table))), f"array<{_CENTRE}>")
        (south, west), (north, east), side, cells = centre_grid([c[1:] for c in table])
        row = F.floor((lat - south) / ((north - south) / side)).try_cast("int")
        column = F.floor((lon - west) / ((east - west) / side)).try_cast("int")
        inside = row.between(0, side - 1) & column.between(0, side - 1)
        near = F.get(_constant([listed(c) for c in cells], f"array<array<{_CENTRE}>>"), row * side + column)
        nearest = F.when(F.coalesce(inside, F.lit(False)), F.aggregate(near, none, closer)["id"]).otherwise(F.aggregate(every, none, closer)["id"])
    return df.withColumn("pickup_cluster", F.when(lat.isNotNull() & lon.isNotNull(), nearest))


_CENTRE = "struct<id:int,a:double,b:double>"


def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def least_squared(centres: Sequence[tuple[int, float, float]]) -> Column:
    """Squared distance of a row's pickup point to the nearest of all centres, in a loop whose code doesn't grow with them."""
    lat, lon = F.col("pickup_latitude"), F.col("pickup_longitude")
    every = _constant([{"id": int(i), "a": float(a), "b": float(b)} for i, a, b in centres], f"array<{_CENTRE}>")
    return F.array_min(F.transform(every, lambda c: (lat - c["a"]) * (lat - c["a"]) + (lon - c["b"]) * (lon - c["b"])))


def centre_grid(points: Sequence[tuple[float, float]]) -> tuple[tuple[float, float], tuple[float, float], int, list[list[int]]]:
    """(lower corner, upper corner, cells a side, numbers of the points that can be nearest per cell, row by row).

    The grid reaches half the points' extent beyond them and has some four cells per point. A point stays on a
    cell's list unless another is nearer to all of the cell: its least distance to the cell exceeds
    the other's greatest. Rounding is allowed for, so no point that ties is left out.
    """
    at = np.array(points, np.float64)
    low, high = at.min(axis=0), at.max(axis=0)
    reach = np.maximum((high - low) / 2, 1e-6 * np.maximum(1.0, np.abs(at).max()))
    low, high = low - reach, high + reach
    side = int(np.ceil(2 * np.sqrt(len(at))))
    step = (high - low) / side
    cells = []
    for row in range(side):
        for column in range(side):
            corner = low + step * (row, column)
            slack = 1e-6 * step
            a, b = corner - slack, corner + step + slack
            least = (np.maximum(np.maximum(a - at, at - b), 0.0) ** 2).sum(axis=1)
            most = (np.maximum(np.abs(at - a), np.abs(at - b)) ** 2).sum(axis=1).min()
            cells.append(np.flatnonzero(least <= most * (1 + 1e-9)).tolist())
    return tuple(low.tolist()), tuple(high.tolist()), side, cells


def centre_table(df: DataFrame, centres: Sequence[tuple[int, float, float]]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(int(i), float(a), float(b)) for i, a, b in centres],
        "pickup_cluster int, cluster_lat double, cluster_lon double",
    )


def attach_centres(df: DataFrame, centres: Sequence[tuple[int, float, float]]) -> DataFrame:
    """Coordinates of the assigned centre; the join strategy follows the number of centres."""
    return df.join(centre_table(df, centres), "pickup_cluster", "left")


def add_zone_coordinates(df: DataFrame, zone: str = "cluster_id") -> DataFrame:
    """Approximate coordinates of a zone, a default for unknown zones."""
    z = F.col(zone)
    lat = lon = None
    for first, last, lat0, lat_n, lat_step, lon0, lon_n, lon_step in ZONE_AREAS:
        inside = z.between(first, last)
        a = F.lit(lat0) + (z % lat_n) * F.lit(lat_step)
        b = F.lit(lon0) - (z % lon_n) * F.lit(lon_step)
        lat = F.when(inside, a) if lat is None else lat.when(inside, a)
        lon = F.when(inside, b) if lon is None else lon.when(inside, b)
    return df.withColumns({"lat": lat.otherwise(DEFAULT_LATITUDE), "lon": lon.otherwise(DEFAULT_LONGITUDE)})


def join_zone_coordinates(df: DataFrame, coordinates: DataFrame, zone: str = "cluster_id") -> DataFrame:
    """As above from a table (zone_id, lat, lon) with one row per zone."""
    table = coordinates.select(F.col("zone_id").alias("_zone"), "lat", "lon")
    return (
        df.join(table, F.col(zone) == F.col("_zone"), "left")
        .withColumn("lat", F.coalesce("lat", F.lit(DEFAULT_LATITUDE)))
        .withColumn("lon", F.coalesce("lon", F.lit(DEFAULT_LONGITUDE)))
        .drop("_zone")
    )
