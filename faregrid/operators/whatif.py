"""What-if pricing for rows, scenario grids and zones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.functions.economics import cost_ratio, demand_after, pct_change, per_unit, revenue_after
from faregrid.params import DEFAULTS, Params

# The scenario grid, in whole percents and tenths.
PRICE_STEPS_PCT = tuple(range(-30, 31, 5))
ELASTICITY_TENTHS = tuple(range(-10, 1))


def simulate(df: DataFrame, price_change: Column, elasticity: Column) -> DataFrame:
    """Every row at a changed price, with the differences to its baseline."""
    demand, fare = F.col("demand_pred"), F.col("avg_fare_pred")
    new_margin = F.when(F.col("new_revenue") > 0, per_unit(F.col("new_profit"), F.col("new_revenue")))
    return (
        df.withColumn("new_fare", fare * (1.0 + price_change))
        .withColumn("new_demand", demand_after(demand, price_change, elasticity))
        .withColumn("new_revenue", revenue_after(demand, fare, price_change, elasticity))
        .withColumn("new_costs", F.col("total_costs") * cost_ratio(F.col("new_demand"), demand))
        .withColumn("new_profit", F.col("new_revenue") - F.col("new_costs"))
        .withColumn("new_margin", F.coalesce(new_margin, F.lit(0.0)))
        .withColumns(
            {
                "demand_change_pct": pct_change(F.col("new_demand"), demand),
                "revenue_change_pct": pct_change(F.col("new_revenue"), F.col("revenue_pred")),
                "profit_change_pct": pct_change(F.col("new_profit"), F.col("profit_pred")),
                "revenue_delta": F.col("new_revenue") - F.col("revenue_pred"),
                "profit_delta": F.col("new_profit") - F.col("profit_pred"),
            }
        )
    )


def simulate_price(df: DataFrame, price_change: float, p: Params = DEFAULTS) -> DataFrame:
    return simulate(df, F.lit(float(price_change)), F.lit(float(p.elasticity)))


def as_structs(simulated: DataFrame) -> DataFrame:
    """Simulation as a baseline, a simulated and a delta struct per row."""
    names = ("demand", "revenue", "profit")
    baseline = [F.col(f"{n}_pred").alias(n) for n in names]
    baseline += [F.col("avg_fare_pred").alias("avg_fare"), F.col("margin_pred").alias("margin")]
    changed = [F.col(f"new_{n}").alias(n) for n in names]
    changed += [F.col("new_fare").alias("avg_fare"), F.col("new_margin").alias("margin")]
    delta = ["demand_change_pct", "revenue_change_pct", "profit_change_pct", "revenue_delta", "profit_delta"]
    return simulated.select(
        "cluster_id",
        "time_bin",
        F.struct(*baseline).alias("baseline"),
        F.struct(*changed).alias("simulated"),
        F.struct(*delta).alias("delta"),
    )


def _with_scenarios(df: DataFrame, prices: Sequence[int], elasticities: Sequence[int]) -> DataFrame:
    """Each row once per scenario; the grid is a fixed literal."""
    return (
        df.withColumn("price_pct", F.explode(F.array(*[F.lit(v) for v in prices])))
        .withColumn("elasticity_tenths", F.explode(F.array(*[F.lit(v) for v in elasticities])))
        .withColumn("_price", F.col("price_pct") / 100.0)
        .withColumn("_elasticity", F.col("elasticity_tenths") / 10.0)
    )


def scenario_grid(
    df: DataFrame,
    prices: Sequence[int] = PRICE_STEPS_PCT,
    elasticities: Sequence[int] = ELASTICITY_TENTHS,
) -> DataFrame:
    """Every row under every scenario of the grid."""
    grid = _with_scenarios(df, prices, elasticities)
    return simulate(grid, F.col("_price"), F.col("_elasticity")).drop("_price", "_elasticity")


def scenario_totals(
    df: DataFrame,
    by: Sequence[str] = (),
    prices: Sequence[int] = PRICE_STEPS_PCT,
    elasticities: Sequence[int] = ELASTICITY_TENTHS,
) -> DataFrame:
    """Totals of the scenario grid, without building it.

    Every simulated value is a row value times a factor of the scenario, so
    four sums per group are enough; only they are multiplied by the grid.
    """
    demand, costs = F.col("demand_pred"), F.col("total_costs")
    sums = df.groupBy(*by).agg(
        F.sum(demand).alias("_demand"),
        F.sum(demand * F.col("avg_fare_pred")).alias("_revenue"),
        F.sum(F.when(demand > 0, costs).otherwise(0.0)).alias("_scaled"),
        F.sum(F.when(demand > 0, 0.0).otherwise(costs)).alias("_fixed"),
        F.sum("revenue_pred").alias("_base_revenue"),
        F.sum("profit_pred").alias("_base_profit"),
    )
    grid = _with_scenarios(sums, prices, elasticities)
    kept = 1.0 + F.col("_elasticity") * F.col("_price")
    return (
        grid.withColumn("new_demand", F.col("_demand") * kept)
        .withColumn("new_revenue", F.col("_revenue") * kept * (1.0 + F.col("_price")))
        .withColumn("new_profit", F.col("new_revenue") - F.col("_scaled") * kept - F.col("_fixed"))
        .withColumn("revenue_delta", F.col("new_revenue") - F.col("_base_revenue"))
        .withColumn("profit_delta", F.col("new_profit") - F.col("_base_profit"))
        .select(
            *by, "price_pct", "elasticity_tenths", "new_demand", "new_revenue", "new_profit",
            "revenue_delta", "profit_delta",
        )
    )


def first_rows(df: DataFrame) -> DataFrame:
    """The earliest row of each zone."""
    columns = [c for c in df.columns if c != "cluster_id"]
    rows = df.where(F.col("cluster_id").isNotNull())
    return rows.groupBy("cluster_id").agg(*[F.min_by(c, "time_bin").alias(c) for c in columns])


def baseline_against_simulated(df: DataFrame, price_change: float, p: Params = DEFAULTS) -> DataFrame:
    """Long form per zone: metric, baseline and simulated value of its first row."""
    simulated = simulate_price(first_rows(df), price_change, p)
    rows = [
        F.struct(F.lit(name).alias("metric"), F.col(f"{name}_pred").alias("baseline"), F.col(f"new_{name}").alias("simulated"))
        for name in ("demand", "revenue", "profit")
    ]
    return simulated.select("cluster_id", F.inline(F.array(*rows)))
