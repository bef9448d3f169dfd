"""Storage, sinks, streams and models."""

from dataclasses import replace
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bindings import tables as t
from bindings.text_queries import DEMAND, _models, _part
from faregrid import storage
from faregrid.models import boosted
from faregrid.operators import metrics, splits
from faregrid.operators.features import add_features, look_back_rows
from faregrid.plans import revenue
from faregrid.sources import predictions as files
from faregrid.sources import sinks, trips
from faregrid.streaming import features as growing
from faregrid.streaming import series as streaming
from tests.conftest import MEDIUM, SMALL


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert storage.fresh_path(spark, "x") != storage.fresh_path(spark, "x")


class FakeCluster:
    """A session without a checkpoint folder on a master of choice."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})()
        self.conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()


def test_a_cluster_must_name_its_shared_folder():
    with pytest.raises(RuntimeError):
        storage.shared_dir(FakeCluster("spark://host:7077"))
    assert "faregrid-" in storage.shared_dir(FakeCluster("local[2]"))


def test_csv_round_trip(spark, tmp_path):
    df = t.predictions(spark, SMALL)
    files.write_predictions(df, str(tmp_path / "csv"), fmt="csv")
    back = files.read_predictions_csv(spark, str(tmp_path / "csv"))
    assert back.exceptAll(df.select(*back.columns)).count() == 0
    assert back.count() == df.count()


def test_partitioned_sink_prunes(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_predictions(t.predictions(spark, SMALL), path, partition_by=["hour"])
    plan = spark.read.parquet(path).where("hour = 7")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan
    with pytest.raises(ValueError):
        files.write_predictions(t.predictions(spark, SMALL), path, fmt="orc")


def test_lines_that_do_not_fit_are_listed(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text("cluster_id,demand,note\n1,2.5,x\n2,many,y\n3,4.0,z\n")
    (tmp_path / "csv" / "b.csv").write_text("cluster_id,demand,note\n4,,\nfive,6.0,u\n6,1.0\n")
    good, rejects = files.read_predictions_with_rejects(spark, str(tmp_path / "csv"), "cluster_id int, demand double, note string")
    assert sorted(map(tuple, good.collect())) == [(1, 2.5, "x"), (3, 4.0, "z"), (4, None, None)]
    assert sorted((r.file.rsplit("/")[-1], r.line) for r in rejects.collect()) == [("a.csv", "2,many,y"), ("b.csv", "6,1.0"), ("b.csv", "five,6.0,u")]
    (tmp_path / "csv" / "a.csv").unlink()
    assert good.count() == 3 and rejects.count() == 3


def test_repeated_runs_leave_one_copy(spark, tmp_path):
    path = str(tmp_path / "parts")
    rows = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("hour"))
    files.replace_partitions(rows, path, ["hour"])
    kept = {f.name for f in (tmp_path / "parts" / "hour=0").iterdir() if f.suffix == ".parquet"}
    for _ in range(2):
        found = files.replace_partitions(rows.where("hour in (1, 2) and id < 50").union(spark.sql("select 7L, 9")), path, ["hour"])
    assert {r.hour: r.n_rows for r in found.collect()} == {0: 20, 1: 10, 2: 10, 3: 20, 4: 20, 9: 1}
    assert spark.read.parquet(path).count() == 81
    assert {f.name for f in (tmp_path / "parts" / "hour=0").iterdir() if f.suffix == ".parquet"} == kept
    with pytest.raises(ValueError):
        files.replace_partitions(rows, path, [])


def test_roles_with_different_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "a int, trip_distance double").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([(3,)], "a int").write.parquet(str(tmp_path / "y"))
    got = trips.load_by_role(spark, {"train": [str(tmp_path / "x")], "test": [str(tmp_path / "y")], "none": []})
    assert {(r.a, r.role, r.trip_distance) for r in got.collect()} == {(1, "train", 2.0), (3, "test", None)}
    with pytest.raises(ValueError):
        trips.load_by_role(spark, {})


def test_summary_is_one_json_line(spark, tmp_path):
    sinks.write_json(sinks.run_summary(t.predictions(spark, SMALL)), str(tmp_path / "s"))
    row = spark.read.json(str(tmp_path / "s")).collect()
    assert len(row) == 1 and row[0].business_metrics.avg_margin == pytest.approx(0.271)


TRIP = (
    "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, PULocationID int, VendorID int, total_amount double, trip_distance double"
)


def made_trips(times):
    """Trips of ten minutes; every seventh is too long a ride to be clean."""
    return [(x, x + timedelta(minutes=10), 1 + i % 3, 1, float(i % 50), 99.0 if i % 7 == 0 else 1.0) for i, x in enumerate(times)]


def trip_files(spark, path, batches, first=0):
    for i, rows in enumerate(batches, first):
        spark.createDataFrame(rows, TRIP).coalesce(1).write.parquet(f"{path}/in/part={i}")


def streamed(spark, path):
    schema = spark.read.parquet(f"{path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = streaming.start_to_table(streaming.windowed_series(stream, t.PARAMS), f"{path}/out", f"{path}/state")
    query.awaitTermination()
    return query, streaming.current_cells(spark, f"{path}/out")


def cells(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def test_stream_equals_batch(spark, tmp_path):
    rows = made_trips([datetime(2024, 1, 1) + timedelta(minutes=7 * i) for i in range(300)])
    trip_files(spark, tmp_path, [rows[:90], rows[90:200], rows[200:]])
    query, out = streamed(spark, tmp_path)
    batch = streaming.windowed_series(spark.read.parquet(f"{tmp_path}/in").drop("part"), t.PARAMS)
    assert cells(out) == cells(batch) and out.count() > 10
    assert streaming.late_rows(query) == 0


def test_stream_resumes_without_repeats(spark, tmp_path):
    rows = made_trips([datetime(2024, 1, 1) + timedelta(hours=i) for i in range(60)])
    trip_files(spark, tmp_path, [rows[:30]])
    _, first = streamed(spark, tmp_path)
    n = first.count()
    trip_files(spark, tmp_path, [rows[30:]], first=1)
    _, second = streamed(spark, tmp_path)
    assert second.count() > n
    assert cells(second) == cells(streaming.windowed_series(spark.read.parquet(f"{tmp_path}/in").drop("part"), t.PARAMS))


def test_late_rows_are_counted(spark, tmp_path):
    start = datetime(2024, 1, 1)
    early, late = made_trips([start + timedelta(hours=i) for i in range(1, 40)]), made_trips([start, start + timedelta(minutes=1)])
    trip_files(spark, tmp_path, [early])
    streamed(spark, tmp_path)
    trip_files(spark, tmp_path, [made_trips([start + timedelta(hours=50)]) + late], first=1)
    query, _ = streamed(spark, tmp_path)
    assert streaming.late_rows(query) > 0


def added(spark, path, **options):
    schema = spark.read.parquet(f"{path}/in").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streaming.start_additive(stream, f"{path}/out", f"{path}/state", t.PARAMS, **options).awaitTermination()
    return streaming.added_cells(spark, f"{path}/out", t.PARAMS)


def test_late_trips_are_added_and_listed(spark, tmp_path):
    rows = made_trips([datetime(2024, 1, 1) + timedelta(minutes=31 * i) for i in range(200)])
    trip_files(spark, tmp_path, [rows[150:], rows[100:150], rows[:50], rows[50:100]])
    out = added(spark, tmp_path)
    batch = streaming.windowed_series(spark.read.parquet(f"{tmp_path}/in").drop("part"), t.PARAMS)
    assert sorted(out.columns) == sorted(batch.columns) and cells(out) == cells(batch)
    late = streaming.late_trips(spark, f"{tmp_path}/out")
    clean = sum(r[5] == 1.0 for r in rows)
    assert 0 < late.count() < clean and {r.batch for r in late.select("batch").distinct().collect()} == {1, 2, 3}
    assert late.where(F.col("bin_start") + t.PARAMS.bin_seconds + 600 > F.col("_closed")).count() == 0
    # Compaction changes nothing, also with batches that come after it.
    assert streaming.compact(spark, f"{tmp_path}/out") == 3 and cells(streaming.added_cells(spark, f"{tmp_path}/out", t.PARAMS)) == cells(batch)
    assert cells(added(spark, tmp_path)) == cells(batch)
    trip_files(spark, tmp_path, [made_trips([datetime(2023, 12, 31)] * 9)], first=4)
    more = added(spark, tmp_path)
    batch = streaming.windowed_series(spark.read.parquet(f"{tmp_path}/in").drop("part"), t.PARAMS)
    assert cells(more) == cells(batch)
    assert streaming.compact(spark, f"{tmp_path}/out") == 4 and cells(streaming.added_cells(spark, f"{tmp_path}/out", t.PARAMS)) == cells(batch)


def test_nothing_is_late_in_one_batch(spark, tmp_path):
    trip_files(spark, tmp_path, [made_trips([datetime(2024, 1, 1) + timedelta(days=i) for i in (9, 0, 5)])])
    assert added(spark, tmp_path).count() == 2 and streaming.late_trips(spark, f"{tmp_path}/out") is None


def test_monitoring_tables_agree(spark):
    feed, actions, report = revenue.monitoring_tables(t.predictions(spark, MEDIUM), t.PARAMS)
    row = report.first()
    assert row.anomalies_detected == feed.count() == 3
    assert row.actions_proposed == actions.count() == 3
    assert row.total_impact == pytest.approx(sum(r.expected_impact for r in actions.collect()))


def test_boosted_model_beats_the_naive_forecast(spark):
    (demand, _), rows = _models(spark, MEDIUM)
    test = _part(rows, "test")
    scored = boosted.score(demand, test)
    model = metrics.metrics(scored, "demand", "demand_pred", ["rmse", "wmape"]).first()
    naive = metrics.metrics(test, "demand", "exp_avg", ["rmse", "wmape"]).first()
    assert model.rmse < naive.rmse and model.wmape < naive.wmape and boosted.tree_count(demand) > 30


def test_scoring_does_not_depend_on_column_order(spark):
    (demand, _), rows = _models(spark, MEDIUM)
    test = _part(rows, "test")
    a = boosted.score(demand, test).agg(F.sum("demand_pred")).first()[0]
    b = boosted.score(demand, test.select(*reversed(test.columns))).agg(F.sum("demand_pred")).first()[0]
    assert a == pytest.approx(b)


def test_saved_model_scores_the_same(spark, tmp_path):
    (demand, _), rows = _models(spark, MEDIUM)
    boosted.save_model(spark, demand, str(tmp_path / "m"))
    loaded, features = boosted.load_model(spark, str(tmp_path / "m"))
    assert {r.feature for r in features.collect()} == set(boosted.MAIN_FEATURES)
    test = _part(rows, "test")
    a, b = (boosted.score(m, test).agg(F.sum("demand_pred")).first()[0] for m in (demand, loaded))
    assert a == b


def test_split_leaves_the_future_for_testing(spark):
    rows = splits.global_split(t.series(spark, MEDIUM), p=t.PARAMS)
    edges = {r.split: (r.lo, r.hi) for r in rows.groupBy("split").agg(F.min("time_bin").alias("lo"), F.max("time_bin").alias("hi")).collect()}
    assert edges["train"][1] <= edges["validation"][0] and edges["validation"][1] <= edges["test"][0]
    assert DEMAND.trees == 1000


def growing_rows(zones=(1, 2, 3), n=400, first=0):
    return [(z, b, (z * 7 + b * b) % 50 + 1, float(b % 13) + z) for z in zones for b in range(first, first + n) if (b * z) % 5]


def test_features_of_a_growing_series(spark, tmp_path):
    kind = "cluster_id int, time_bin int, demand long, avg_fare double"
    p = replace(t.PARAMS, rolling_windows=(7, 30))
    rows = growing_rows()
    batches = [[r for r in rows if low <= r[1] < low + 100] for low in (0, 100, 200)] + [[r for r in rows if r[1] >= 300] + [(4, 5, 9, 1.0)]]
    sizes = []
    for number, batch in enumerate(batches):
        got = growing.advance(spark.createDataFrame(batch, kind), number, str(tmp_path), p=p, previous=["avg_fare"])
        assert got.count() == len(batch)
        sizes.append(spark.read.parquet(f"{tmp_path}/state/batch={number}").groupBy("cluster_id").count().agg(F.max("count")).first()[0])
    assert sizes[1:] == [look_back_rows(p)] * 3

    def same(everything):
        want = add_features(spark.createDataFrame(everything, kind), p=p, previous=["avg_fare"]).drop("n_rows").toPandas()
        found = growing.current_features(spark, str(tmp_path)).toPandas()[want.columns]
        key = ["cluster_id", "time_bin"]
        pd.testing.assert_frame_equal(found.sort_values(key, ignore_index=True), want.sort_values(key, ignore_index=True), check_dtype=False, rtol=1e-9)

    same(sum(batches, []))
    # Zone 2 changes a cell and gets one between; the others aren't written again. The batch comes twice.
    late = [(2, 151, 99, 2.0), (2, 150, 77, 3.0), (1, 900, 5, 1.0)]
    for _ in range(2):
        got = growing.advance(spark.createDataFrame(late, kind), 4, str(tmp_path), p=p, previous=["avg_fare"])
        assert {r.cluster_id: r["count"] for r in got.groupBy("cluster_id").count().collect()}[1] == 1
    changed = [r for r in sum(batches, []) if r[:2] not in ((2, 151), (2, 150))] + late
    same(changed)
