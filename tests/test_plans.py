"""Shape of the physical plans."""

import pytest

from bindings import tables as t
from bindings.registry import ENTRIES
from faregrid.operators import clean, drilldown, metrics, recommend
from faregrid.plans import revenue
from tests.conftest import SMALL

EAGER = ("m1", "m2", "m3", "m4", "m5", "m7", "m_", "s8", "x1", "x2", "z2")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in ENTRIES if not n.startswith(EAGER)])
def test_no_cross_join_and_no_row_python(spark, name):
    plan = plan_of(ENTRIES[name].query(spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


@pytest.fixture(scope="module")
def trip_file(spark, tmp_path_factory):
    """Trips as a file of their own, as a user of the library has them."""
    path = str(tmp_path_factory.mktemp("trips") / "trips")
    t.trips(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_bounds_reach_the_scan(spark, trip_file):
    df = clean.clean_main(trip_file, t.PARAMS)
    scan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    pushed = scan[scan.index("PushedFilters") :].splitlines()[0]
    assert "LessThanOrEqual(trip_distance,23.0)" in pushed
    assert "LessThanOrEqual(total_amount,1000.0)" in pushed


def test_duration_is_computed_once(spark):
    df = clean.clean_main(t.trips(spark, SMALL), t.PARAMS)
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("interval second") == 1


def test_series_reads_only_what_it_needs(trip_file):
    plan = plan_of(revenue.main_series(trip_file, t.PARAMS))
    schema = plan[plan.index("ReadSchema") :]
    assert "passenger_count" not in schema.split(">")[0]
    assert "latitude" not in schema
    assert "SortAggregate" not in plan


def test_top_k_is_not_a_full_sort(spark):
    plan = plan_of(recommend.weekend_incentive(t.predictions(spark, SMALL)))
    assert "TakeOrderedAndProject" in plan


def test_rows_are_not_shuffled_on_groups(spark):
    rows = t.predictions(spark, SMALL)
    for df in (
        metrics.full_metrics(rows, "demand", "demand_pred", by=["is_weekend"]),
        metrics.prediction_intervals(rows, "revenue_pred", ["cluster_id"]),
        drilldown.zone_drilldown(rows),
        drilldown.insight_cards(rows),
    ):
        lines = plan_of(df).splitlines()
        assert not [x for x in lines if "SortMergeJoin [is_weekend" in x or "SortMergeJoin [cluster_id" in x and "time_bin" in x]
        assert all("cell" in x for x in lines if "Window [sum(c#" in x)


def test_a_partitioned_sink_may_split_a_value(spark):
    plan = plan_of(t.predictions(spark, SMALL).hint("rebalance", "day_of_week"))
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
