"""What-if, metrics, anomalies and recommendations on literal tables."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faregrid.operators import anomalies, answers, drilldown, forecast, metrics, portfolio, recommend, whatif
from faregrid.params import DEFAULTS

BASE = "cluster_id int, time_bin int, demand_pred double, revenue_pred double"


def predictions(spark, rows, p=DEFAULTS):
    df = spark.createDataFrame(rows, BASE)
    return forecast.predictions_table(df, p).withColumns({"hour": F.lit(9), "is_weekend": F.lit(1), "is_rush_hour": F.lit(1)})


def test_published_price_example(spark):
    """+10 % at 74.81 of revenue: 78.18, profit 26.37, margin 33.7 %."""
    row = whatif.simulate_price(predictions(spark, [(1, 0, 4.4, 74.81)]), 0.10).first()
    assert row.new_demand == pytest.approx(4.18)
    assert row.new_revenue == pytest.approx(78.18, abs=0.005)
    assert row.new_profit == pytest.approx(26.37, abs=0.006)
    assert row.new_margin == pytest.approx(0.337, abs=0.0005)
    assert row.revenue_change_pct == pytest.approx(4.5, abs=0.01)
    assert row.profit_change_pct == pytest.approx(30.1, abs=0.05)


def test_no_demand_keeps_costs(spark):
    df = predictions(spark, [(1, 0, 0.0, 0.0)]).withColumn("total_costs", F.lit(5.0)).withColumn("avg_fare_pred", F.lit(3.0))
    row = whatif.simulate_price(df, 0.10).first()
    assert row.new_costs == 5.0
    assert row.new_margin == 0.0
    assert row.demand_change_pct is None


def test_totals_equal_the_grid(spark):
    df = predictions(spark, [(1, 0, 4.0, 50.0), (1, 1, 6.0, 80.0), (2, 0, 0.0, 10.0), (2, 1, 3.0, 33.0)])
    keys = ["cluster_id", "price_pct", "elasticity_tenths"]
    names = ["new_profit", "new_demand"]
    grid = whatif.scenario_grid(df.fillna(0.0, ["avg_fare_pred"])).groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    want = grid.toPandas().sort_values(keys).reset_index(drop=True)
    got = whatif.scenario_totals(df.fillna(0.0, ["avg_fare_pred"]), ["cluster_id"]).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(got) == 2 * 13 * 11
    for name in names:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-9)


def test_long_form_uses_the_first_row(spark):
    df = predictions(spark, [(1, 5, 4.0, 50.0), (1, 2, 6.0, 80.0)])
    rows = {r.metric: r for r in whatif.baseline_against_simulated(df, 0.0).collect()}
    assert rows["demand"].baseline == 6.0 and rows["demand"].simulated == 6.0
    assert rows["profit"].simulated == pytest.approx(80.0 * 0.271)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 20, 400).astype(float)
    b = a + rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b})).repartition(4)
    got = metrics.full_metrics(df, "a", "b").first()
    nonzero = a != 0
    assert got.mae == pytest.approx(np.mean(np.abs(a - b)))
    assert got.rmse == pytest.approx(np.sqrt(np.mean((a - b) ** 2)))
    assert got.mape == pytest.approx(np.mean(np.abs((a - b)[nonzero] / a[nonzero])))
    assert got.r2 == pytest.approx(1 - np.sum((a - b) ** 2) / np.sum((a - a.mean()) ** 2))
    assert got.max_error == pytest.approx(np.max(np.abs(a - b)))
    assert got.median_ae == pytest.approx(np.median(np.abs(a - b)))
    assert got.std_actual == pytest.approx(np.std(a))
    assert got.std_predicted == pytest.approx(np.std(b))


@pytest.mark.parametrize(("rows", "r2"), [([(3.0, 3.0), (3.0, 3.0)], 1.0), ([(3.0, 2.0), (3.0, 3.0)], 0.0)])
def test_r2_of_constant_actuals(spark, rows, r2):
    df = spark.createDataFrame(rows, "a double, b double")
    assert metrics.metrics(df, "a", "b", ["r2"]).first().r2 == r2


def test_mape_of_zero_actuals_is_infinite(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "a double, b double")
    got = metrics.metrics(df, "a", "b", ["mape", "wmape"]).first()
    assert got.mape == float("inf") and got.wmape is None


def test_zero_midpoint_is_certain(spark):
    df = spark.createDataFrame([(-2.0, 2.0), (1.0, 3.0), (9.0, 11.0)], "lower double, upper double")
    got = metrics.add_uncertainty_flag(df).collect()
    assert [r.high_uncertainty for r in got] == [0, 1, 0]
    assert [r.interval_width for r in metrics.add_interval_width(df).collect()] == [4.0, 2.0, 2.0]


def test_published_surge_impact(spark):
    """615.0677 at +15 % and elasticity -0.5 gains 39.21."""
    rows = [(236, 0, 51.85106, 615.0677)] + [(z, 1, 5.0, 100.0 + z) for z in range(1, 9)]
    got = recommend.surge_pricing(predictions(spark, rows)).collect()
    assert [r.zone_id for r in got] == [236]
    assert got[0].expected_impact == pytest.approx(39.2106, abs=1e-3)
    assert got[0].expected_revenue == pytest.approx(654.2783, abs=1e-3)
    assert got[0].confidence == "high"
    assert got[0].rationale == "Demand of 51.9 trips at a fare below the median"


def test_published_weekend_impact(spark):
    got = recommend.weekend_incentive(predictions(spark, [(132, 3, 80.0, 5434.4414), (1, 0, 2.0, 30.0)])).first()
    assert (got.zone_id, round(got.expected_impact, 2)) == (132, 543.44)


def test_discount_is_picked_before_it_is_tested(spark):
    rows = [(z, z, float(z), 10.0 * z) for z in range(1, 13)]
    assert recommend.discounts(predictions(spark, rows)).count() == 0
    elastic = recommend.discounts(predictions(spark, rows), replace(DEFAULTS, elasticity=-1.5)).collect()
    assert [r.zone_id for r in elastic] == [1, 2]
    assert elastic[0].expected_impact == pytest.approx(10.0 * (1.15 * 0.9 - 1))


def test_reallocation_needs_twice_the_demand(spark):
    assert recommend.reallocation(predictions(spark, [(1, 0, 5.0, 50.0), (2, 0, 10.0, 90.0)])).count() == 0
    got = recommend.reallocation(predictions(spark, [(1, 0, 5.0, 50.0), (2, 0, 10.1, 101.0)])).first()
    assert (got.source_zone, got.dest_zone, got.expected_impact) == (1, 2, pytest.approx(20.0))


def test_cost_rule_with_a_low_margin(spark):
    p = replace(DEFAULTS, driver_share=0.8)
    got = recommend.cost_optimisation(predictions(spark, [(1, 0, 5.0, 50.0), (2, 0, 9.0, 90.0), (3, 0, 7.0, 70.0)], p), p).collect()
    assert [r.zone_id for r in got] == [2]
    assert got[0].expected_impact == pytest.approx(90 * 0.05 * 0.2)
    assert got[0].expected_margin == pytest.approx(got[0].current_margin + 0.01)


def test_feed_of_an_empty_table(spark):
    assert recommend.recommendation_feed(predictions(spark, [])).count() == 0


def zone_rows(revenues, demand=10.0):
    return [(z, 0, demand, r) for z, r in revenues.items()]


def test_too_few_high_impact_zones(spark):
    zones = portfolio.zone_statistics(predictions(spark, zone_rows({z: 100.0 * z for z in range(1, 11)})))
    high = anomalies.high_impact_zones(zones)
    assert high.count() == 4
    assert anomalies.enough_zones(high).count() == 0
    assert anomalies.anomaly_feed(zones).count() == 0


def test_feed_against_pandas(spark):
    rng = np.random.default_rng(5)
    revenue = {z: float(v) for z, v in zip(range(1, 41), np.round(rng.pareto(1.2, 40) * 1000 + 200, 2))}
    demand = {z: float(v) for z, v in zip(range(1, 41), rng.uniform(5, 90, 40))}
    df = predictions(spark, [(z, 0, demand[z], revenue[z]) for z in revenue])
    rev = pd.Series(revenue)
    high = rev[rev >= rev.quantile(0.6)]
    tercile = pd.qcut(high, 3, labels=["small", "medium", "large"])
    found = []
    for name in ("small", "medium", "large"):
        part = high[tercile == name]
        if len(part) < 2:
            continue
        bench = part.quantile(0.75)
        short = part[part < bench * 0.9]
        if len(short):
            found.append((short.index[0], bench * 0.95 - short.iloc[0]))
    found.sort(key=lambda x: -x[1])
    rpt = high / pd.Series(demand)[high.index]
    target = rpt.quantile(0.75)
    low = high[rpt < target * 0.9].sort_values(ascending=False).index[:2]
    got = anomalies.anomaly_feed(portfolio.zone_statistics(df)).orderBy("anomaly_no").collect()
    assert [r.zone_id for r in got] == [z for z, _ in found] + list(low)
    for row, (_, gain) in zip(got, found):
        assert row.potential_gain == pytest.approx(gain)
        assert row.expected_value > row.current_value


def test_equal_edges_leave_the_middle_empty(spark):
    zones = portfolio.zone_statistics(predictions(spark, zone_rows({z: 100.0 for z in range(1, 8)})))
    got = anomalies.revenue_terciles(anomalies.high_impact_zones(zones))
    assert {r.tercile for r in got.collect()} == {"small"}


def test_alert_reasons(spark):
    df = predictions(spark, [(1, 0, 5.0, 100.0), (2, 0, 5.0, 100.0), (3, 0, 5.0, 100.0)])
    df = df.withColumn("revenue_total", F.when(F.col("cluster_id") == 1, 130.0).otherwise(110.0))
    df = df.withColumn("margin_pred", F.when(F.col("cluster_id") == 2, -0.1).otherwise(0.27))
    got = {r.cluster_id: r.reasons for r in anomalies.threshold_alerts(df).collect()}
    assert got == {1: ["revenue_variance"], 2: ["negative_margin"]}


def test_empty_slice_and_coverage(spark):
    df = predictions(spark, [(1, 0, 5.0, 50.0)])
    empty = answers.slice_rows(df, hour=3)
    assert answers.peak_cell(empty).count() == 0
    assert answers.alternatives(empty).count() == 0
    assert answers.deployment(empty).count() == 0
    got = answers.coverage(df).first()
    assert (got.n_rows, got.zones) == (1, 1)


def test_day_part_is_ignored_with_an_hour(spark):
    df = predictions(spark, [(1, 0, 5.0, 50.0)])
    assert answers.slice_rows(df, hour=9, day_part="night").count() == 1


def test_ties_go_to_the_lower_zone(spark):
    df = predictions(spark, [(z, 0, 5.0, 50.0) for z in range(9, 0, -1)])
    assert [r.cluster_id for r in answers.ranked_zones(df, "revenue", 5).collect()] == [1, 2, 3, 4, 5]
    assert [r.cluster_id for r in answers.ranked_zones(df, "demand", 3, True).collect()] == [1, 2, 3]


def test_comparison_needs_both_zones(spark):
    df = predictions(spark, [(1, 0, 0.0, 0.0), (2, 0, 0.0, 5.0)])
    assert answers.compare_two_zones(df, 1, 9).count() == 0
    got = answers.compare_two_zones(df, 1, 2).first()
    assert (got.demand_diff_pct, got.per_trip_2) == (0.0, 0.0)


def test_drilldown_with_zero_demand(spark):
    df = predictions(spark, [(1, 4, 0.0, 7.0), (1, 2, 2.0, 8.0), (1, 9, 2.0, 8.0)])
    got = drilldown.zone_drilldown(df).first()
    assert (got.highest_period, got.lowest_period, got.max_price, got.min_price) == (1, 2, 7.0, 4.0)


def test_quality_report_counts_signs(spark):
    df = predictions(spark, [(1, 0, 1.0, -5.0), (2, 0, 1.0, 5.0), (3, 0, 1.0, 0.0)])
    got = portfolio.quality_report(df).first()
    assert (got.negative_zones, got.positive_zones, got.zones, got.n_rows) == (1, 1, 3, 3)
