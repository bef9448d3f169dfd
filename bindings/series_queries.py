"""Window features, splits, profit, what-if and metric queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from bindings import base_sql as b
from bindings import tables as t
from bindings.registry import query
from bindings.trip_queries import PRED_DOUBLES, SERIES_DOUBLES
from faregrid.operators import drilldown, features, forecast, metrics, splits, whatif
from faregrid.plans import revenue
from faregrid.storage import staged

P = t.PARAMS
LAGS = "ft_1, ft_2, ft_3, ft_4, ft_5"
KEYS = "cluster_id, time_bin"


@query("w1_lags", f"WITH {b.LAGGED} -- result\nSELECT {KEYS}, demand, {LAGS} FROM lagged")
def w1(spark, sf):
    return features.add_features(t.series(spark, sf), p=P).select(
        "cluster_id", "time_bin", "demand", *[f"ft_{k}" for k in range(1, 6)]
    )


@query("w2_rolling_means", f"""WITH {b.SERIES} -- result
    SELECT {KEYS}, avg(demand) OVER (PARTITION BY cluster_id ORDER BY time_bin ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
        AS rolling_avg_7,
      avg(demand) OVER (PARTITION BY cluster_id ORDER BY time_bin ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
        AS rolling_avg_30 FROM series""", "rolling_avg_7 rolling_avg_30")
def w2(spark, sf):
    return features.add_features(t.series(spark, sf), p=P).select(
        "cluster_id", "time_bin", "rolling_avg_7", "rolling_avg_30"
    )


@query("w3_normalised_average", f"WITH {b.FEATURES} -- result\nSELECT {KEYS}, exp_avg FROM features", "exp_avg")
def w3(spark, sf):
    return features.main_features(t.series(spark, sf), P).select("cluster_id", "time_bin", "exp_avg")


_RECURSIVE = """ranked AS (
      SELECT {zone} AS z, {bins} AS bin, demand, row_number() OVER (PARTITION BY {zone} ORDER BY {bins}) AS pos FROM {source}
    ),
    recursive_averages AS (
      SELECT a.z, a.bin, sum(CASE WHEN b.pos = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, a.pos - 1 - b.pos) * b.demand) AS exp_avg
      FROM ranked a LEFT JOIN ranked b ON a.z = b.z AND b.pos < a.pos GROUP BY a.z, a.bin
    )"""


@query("w4_recursive_average", f"""WITH {b.SERIES}, {_RECURSIVE.format(zone="cluster_id", bins="time_bin", source="series")}
    -- result
    SELECT z AS cluster_id, bin AS time_bin, exp_avg AS exp_avg_recursive FROM recursive_averages""", "exp_avg_recursive")
def w4(spark, sf):
    return features.add_features(t.series(spark, sf), p=P).select("cluster_id", "time_bin", "exp_avg_recursive")


LONG = replace(P, rolling_windows=(144, 1008))


@query("w3_long_windows", f"""WITH {b.SERIES}, {_RECURSIVE.format(zone="cluster_id", bins="time_bin", source="series")}
    -- result
    SELECT {KEYS}, avg(demand) OVER (PARTITION BY cluster_id ORDER BY time_bin ROWS BETWEEN 144 PRECEDING AND 1 PRECEDING)
        AS rolling_avg_144,
      avg(demand) OVER (PARTITION BY cluster_id ORDER BY time_bin ROWS BETWEEN 1008 PRECEDING AND 1 PRECEDING)
        AS rolling_avg_1008, r.exp_avg AS exp_avg_recursive
    FROM series LEFT JOIN recursive_averages r ON cluster_id = r.z AND time_bin = r.bin""",
       "rolling_avg_144 rolling_avg_1008 exp_avg_recursive")
def w3_long(spark, sf):
    return features.add_features(t.series(spark, sf), p=LONG).select(
        "cluster_id", "time_bin", "rolling_avg_144", "rolling_avg_1008", "exp_avg_recursive"
    )


@query("w5_complete_rows", f"""WITH {b.FEATURES} -- result
    SELECT * EXCLUDE (pos, prev_avg_fare) FROM features""", SERIES_DOUBLES + " exp_avg")
def w5(spark, sf):
    return features.main_features(t.series(spark, sf), P).drop("pos")


LIBRARY_ROWS = f"""{b.LIBRARY_CELLS},
    {_RECURSIVE.format(zone="pickup_cluster", bins="pickup_bins", source="cells")},
    windows AS (
      SELECT pickup_cluster, pickup_bins, demand, revenue, lag(demand, 1) OVER w AS ft_1, lag(demand, 5) OVER w AS ft_5,
        avg(demand) OVER (PARTITION BY pickup_cluster ORDER BY pickup_bins ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
          AS rolling_avg_7,
        avg(demand) OVER (PARTITION BY pickup_cluster ORDER BY pickup_bins ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
          AS rolling_avg_30
      FROM cells WINDOW w AS (PARTITION BY pickup_cluster ORDER BY pickup_bins)
    ), library_rows AS (
      SELECT windows.*, r.exp_avg, c.cluster_lat, c.cluster_lon
      FROM windows JOIN recursive_averages r ON pickup_cluster = r.z AND pickup_bins = r.bin
        JOIN centres c USING (pickup_cluster) WHERE ft_5 IS NOT NULL
    )"""


@query("w6_library_features", f"WITH {LIBRARY_ROWS} -- result\nSELECT * FROM library_rows",
       "revenue rolling_avg_7 rolling_avg_30 exp_avg cluster_lat cluster_lon")
def w6(spark, sf):
    table = revenue.library_feature_table(t.library_cells(spark, sf), t.CENTRES, P)
    return table.select(
        "pickup_cluster", "pickup_bins", "demand", "revenue", "ft_1", "ft_5", "rolling_avg_7", "rolling_avg_30",
        "exp_avg", "cluster_lat", "cluster_lon",
    )


LABEL = """CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'validation' ELSE 'test' END AS split"""


@query("w7_global_split", f"""WITH {b.SERIES}, placed AS (
      SELECT {KEYS}, row_number() OVER (ORDER BY time_bin, cluster_id) - 1 AS i, count(*) OVER () AS n FROM series
    ) -- result
    SELECT {KEYS}, {LABEL} FROM placed""")
def w7(spark, sf):
    return splits.global_split(t.series(spark, sf), p=P).select("cluster_id", "time_bin", "split")


@query("w8_zone_split", f"""WITH {b.SERIES}, placed AS (
      SELECT {KEYS}, row_number() OVER (PARTITION BY cluster_id ORDER BY time_bin) - 1 AS i,
        count(*) OVER (PARTITION BY cluster_id) AS n FROM series
    ) -- result
    SELECT {KEYS}, {LABEL} FROM placed""")
def w8(spark, sf):
    return splits.zone_split(t.series(spark, sf), p=P).select("cluster_id", "time_bin", "split")


@query("w9_periods", f"""WITH {b.PREDICTIONS} -- result
    SELECT {KEYS}, row_number() OVER (PARTITION BY cluster_id ORDER BY time_bin) AS period,
      revenue_pred / CASE WHEN demand_pred = 0 THEN 1 ELSE demand_pred END AS price_per_trip FROM predictions""",
       "price_per_trip")
def w9(spark, sf):
    return drilldown.add_periods(t.predictions(spark, sf)).select("cluster_id", "time_bin", "period", "price_per_trip")


@query("w10_zone_change", f"""WITH {b.PREDICTIONS}, ends AS (
      SELECT cluster_id, count(*) AS periods, arg_min(revenue_pred, time_bin) AS first_revenue,
        arg_max(revenue_pred, time_bin) AS last_revenue, arg_min(demand_pred, time_bin) AS first_demand,
        arg_max(demand_pred, time_bin) AS last_demand, arg_max(hour, time_bin) AS hour,
        arg_max(day_of_week, time_bin) AS day_of_week, arg_max(is_weekend, time_bin) AS is_weekend,
        arg_max(is_rush_hour, time_bin) AS is_rush_hour
      FROM predictions GROUP BY cluster_id HAVING count(*) >= 2
    ) -- result
    SELECT *, (last_revenue - first_revenue) / first_revenue * 100 AS change_pct,
      CASE WHEN last_revenue > first_revenue THEN 'increase' ELSE 'decrease' END AS direction,
      CASE WHEN last_demand > first_demand THEN 'increasing' ELSE 'decreasing' END AS demand_trend FROM ends""",
       "first_revenue last_revenue first_demand last_demand change_pct")
def w10(spark, sf):
    return drilldown.zone_change(t.predictions(spark, sf))


def _features(spark, sf):
    return features.main_features(t.series(spark, sf), P, previous=["avg_fare"])


@query("p1_predicted_fare", f"WITH {b.PREDICTIONS} -- result\nSELECT {KEYS}, avg_fare_pred FROM predictions", "avg_fare_pred")
def p1(spark, sf):
    return forecast.add_fare(t.rounded(forecast.naive_forecast(_features(spark, sf)))).select("cluster_id", "time_bin", "avg_fare_pred")


COSTS = ["driver_costs", "processing_fees", "ops_costs", "total_costs"]


@query("p2_cost_stack", f"WITH {b.PREDICTIONS} -- result\nSELECT {KEYS}, {', '.join(COSTS)} FROM predictions", " ".join(COSTS))
def p2(spark, sf):
    return forecast.add_costs(t.rounded(forecast.naive_forecast(_features(spark, sf))), P).select("cluster_id", "time_bin", *COSTS)


@query("p3_profit_and_margin", f"WITH {b.PREDICTIONS} -- result\nSELECT {KEYS}, profit_pred, margin_pred FROM predictions",
       "profit_pred margin_pred")
def p3(spark, sf):
    return t.predictions(spark, sf).select("cluster_id", "time_bin", "profit_pred", "margin_pred")


def _whatif_sql(source, price, elasticity, extra=""):
    return f"""changed AS (
      SELECT *, avg_fare_pred * (1 + {price}) AS new_fare, demand_pred * (1 + {elasticity} * {price}) AS new_demand,
        demand_pred * (1 + {elasticity} * {price}) * avg_fare_pred * (1 + {price}) AS new_revenue,
        total_costs * CASE WHEN demand_pred > 0 THEN 1 + {elasticity} * {price} ELSE 1 END AS new_costs {extra}
      FROM {source}
    ),
    simulated AS (
      SELECT *, new_revenue - new_costs AS new_profit,
        CASE WHEN new_revenue > 0 THEN (new_revenue - new_costs) / new_revenue ELSE 0 END AS new_margin FROM changed
    )"""


@query("p4_what_if", f"""WITH {b.PREDICTIONS}, {_whatif_sql("predictions", "0.1", "-0.5")} -- result
    SELECT {KEYS}, new_demand, new_revenue, new_profit, new_fare, new_margin,
      (new_demand - demand_pred) / demand_pred * 100 AS demand_change_pct,
      (new_revenue - revenue_pred) / revenue_pred * 100 AS revenue_change_pct,
      (new_profit - profit_pred) / profit_pred * 100 AS profit_change_pct,
      new_revenue - revenue_pred AS revenue_delta, new_profit - profit_pred AS profit_delta FROM simulated""",
       "new_demand new_revenue new_profit new_fare new_margin demand_change_pct revenue_change_pct profit_change_pct "
       "revenue_delta profit_delta")
def p4(spark, sf):
    simulated = whatif.as_structs(whatif.simulate_price(t.predictions(spark, sf), 0.10, P))
    changed = [F.col(f"simulated.{n}").alias(f"new_{n}") for n in ("demand", "revenue", "profit")]
    return simulated.select(
        "cluster_id", "time_bin", *changed, F.col("simulated.avg_fare").alias("new_fare"),
        F.col("simulated.margin").alias("new_margin"), "delta.*",
    )


_GRID = """grid AS (
      SELECT CAST(p AS INTEGER) AS price_pct, CAST(e AS INTEGER) AS elasticity_tenths, p / 100 AS price, e / 10 AS elast
      FROM range(-30, 31, 5) prices(p), range(-10, 1) tenths(e)
    ),
    expanded AS (SELECT * FROM predictions, grid)"""
_GRID_SUMS = """sum(new_demand) AS new_demand, sum(new_revenue) AS new_revenue, sum(new_profit) AS new_profit,
      sum(new_revenue - revenue_pred) AS revenue_delta, sum(new_profit - profit_pred) AS profit_delta"""
GRID_DOUBLES = "new_demand new_revenue new_profit revenue_delta profit_delta"


@query("p5_scenario_grid", f"""WITH {b.PREDICTIONS}, {_GRID}, {_whatif_sql("expanded", "price", "elast")} -- result
    SELECT hour, price_pct, elasticity_tenths, {_GRID_SUMS} FROM simulated GROUP BY 1, 2, 3""", GRID_DOUBLES)
def p5(spark, sf):
    grid = whatif.scenario_grid(t.predictions(spark, sf))
    names = GRID_DOUBLES.split()
    return grid.groupBy("hour", "price_pct", "elasticity_tenths").agg(*[F.sum(n).alias(n) for n in names])


@query("p5_scenario_totals", f"""WITH {b.PREDICTIONS}, {_GRID}, {_whatif_sql("expanded", "price", "elast")} -- result
    SELECT cluster_id, price_pct, elasticity_tenths, {_GRID_SUMS} FROM simulated GROUP BY 1, 2, 3""", GRID_DOUBLES)
def p5_totals(spark, sf):
    return whatif.scenario_totals(t.predictions(spark, sf), by=["cluster_id"])


@query("p6_baseline_and_simulated", f"""WITH {b.PREDICTIONS}, firsts AS (
      SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY time_bin) = 1
    ), {_whatif_sql("firsts", "0.15", "-0.5")} -- result
    SELECT cluster_id, 'demand' AS metric, demand_pred AS baseline, new_demand AS simulated FROM simulated
    UNION ALL SELECT cluster_id, 'revenue', revenue_pred, new_revenue FROM simulated
    UNION ALL SELECT cluster_id, 'profit', profit_pred, new_profit FROM simulated""", "baseline simulated")
def p6(spark, sf):
    return whatif.baseline_against_simulated(t.predictions(spark, sf), 0.15, P)


@query("m6_naive_forecast", f"WITH {b.PREDICTIONS} -- result\nSELECT * FROM predictions", PRED_DOUBLES)
def m6(spark, sf):
    return t.predictions_of(t.series(spark, sf))


def _metric(spark, sf, names):
    return metrics.metrics(t.predictions(spark, sf), "demand", "demand_pred", names)


@query("e1_mape_percent", f"""WITH {b.PREDICTIONS} -- result
    SELECT avg(abs((demand - demand_pred) / nullif(demand, 0))) * 100 AS mape_pct FROM predictions""", "mape_pct")
def e1(spark, sf):
    return _metric(spark, sf, ["mape_pct"])


@query("e2_mape_fraction", f"""WITH {b.PREDICTIONS} -- result
    SELECT avg(abs((demand - demand_pred) / demand)) AS mape FROM predictions WHERE demand <> 0""", "mape")
def e2(spark, sf):
    return _metric(spark, sf, ["mape"])


@query("e3_wmape", f"""WITH {b.PREDICTIONS} -- result
    SELECT sum(abs(demand - demand_pred)) / sum(abs(demand)) * 100 AS wmape FROM predictions""", "wmape")
def e3(spark, sf):
    return _metric(spark, sf, ["wmape"])


def _full_sql(a, p):
    return f"""avg(abs({a} - {p})) AS mae, sqrt(avg(pow({a} - {p}, 2))) AS rmse,
      1 - sum(pow({a} - {p}, 2)) / (count(*) * var_pop({a})) AS r2"""


@query("e4_mae_rmse_r2", f"WITH {b.PREDICTIONS} -- result\nSELECT {_full_sql('demand', 'demand_pred')} FROM predictions",
       "mae rmse r2")
def e4(spark, sf):
    return _metric(spark, sf, ["mae", "rmse", "r2"])


def _all_sql(a, p):
    return f"""{_full_sql(a, p)}, avg(abs(({a} - {p}) / nullif({a}, 0))) AS mape, max(abs({a} - {p})) AS max_error,
      avg({a}) AS mean_actual, avg({p}) AS mean_predicted, stddev_pop({a}) AS std_actual, stddev_pop({p}) AS std_predicted,
      quantile_cont(abs({a} - {p}), 0.5) AS median_ae"""


FULL_DOUBLES = "mae rmse r2 mape max_error mean_actual mean_predicted std_actual std_predicted median_ae"


@query("e5_full_metrics", f"""WITH {b.PREDICTIONS} -- result
    SELECT {_all_sql('revenue_total', 'revenue_pred')} FROM predictions""", FULL_DOUBLES)
def e5(spark, sf):
    return metrics.full_metrics(t.predictions(spark, sf), "revenue_total", "revenue_pred")


@query("e6_metrics_per_split", f"""WITH {b.PREDICTIONS}, placed AS (
      SELECT *, row_number() OVER (ORDER BY time_bin, cluster_id) - 1 AS i, count(*) OVER () AS n FROM predictions
    ), labelled AS (SELECT *, {LABEL} FROM placed) -- result
    SELECT split, {_all_sql('demand', 'demand_pred')} FROM labelled GROUP BY split""", FULL_DOUBLES)
def e6(spark, sf):
    labelled = staged(splits.global_split(t.predictions(spark, sf), p=P), "labelled-predictions")
    return metrics.full_metrics(labelled, "demand", "demand_pred", by=["split"])


_INTERVALS = """intervals AS (
      SELECT cluster_id, hour, quantile_cont(revenue_total, 0.05) AS lower, quantile_cont(revenue_total, 0.95) AS upper
      FROM series GROUP BY cluster_id, hour
    )"""


def _intervals(spark, sf):
    return metrics.prediction_intervals(t.series(spark, sf), "revenue_total", ["cluster_id", "hour"], 0.9)


@query("e7_prediction_intervals", f"WITH {b.SERIES}, {_INTERVALS} -- result\nSELECT * FROM intervals", "lower upper")
def e7(spark, sf):
    return _intervals(spark, sf)


@query("e8_interval_width", f"""WITH {b.SERIES}, {_INTERVALS} -- result
    SELECT cluster_id, hour, upper - lower AS interval_width FROM intervals""", "interval_width")
def e8(spark, sf):
    return metrics.add_interval_width(_intervals(spark, sf)).select("cluster_id", "hour", "interval_width")


@query("e9_high_uncertainty", f"""WITH {b.SERIES}, {_INTERVALS}, relative AS (
      SELECT cluster_id, hour, CASE WHEN (lower + upper) / 2 <> 0 THEN (upper - lower) / ((lower + upper) / 2) ELSE 0 END
        AS relative_width FROM intervals) -- result
    SELECT *, CAST(relative_width > 0.3 AS INTEGER) AS high_uncertainty FROM relative""", "relative_width")
def e9(spark, sf):
    return metrics.add_uncertainty_flag(_intervals(spark, sf), 0.3).select(
        "cluster_id", "hour", "relative_width", "high_uncertainty"
    )
