"""Cost, profit and price-change expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faregrid.params import Params


def per_unit(total: Column, units: Column) -> Column:
    """``total / units``; NULL where there are no units."""
    return F.try_divide(total, units)


def pct_change(new: Column, old: Column) -> Column:
    return F.try_divide(new - old, old) * 100.0


def cost_columns(revenue: Column, p: Params) -> dict[str, Column]:
    """Cost stack of a revenue column, as shares of it."""
    driver = revenue * F.lit(p.driver_share)
    fees = revenue * F.lit(p.processing_share)
    operations = revenue * F.lit(p.operations_share)
    return {
        "driver_costs": driver,
        "processing_fees": fees,
        "ops_costs": operations,
        "total_costs": driver + fees + operations,
    }


def demand_after(demand: Column, price_change: Column, elasticity: Column) -> Column:
    return demand * (1.0 + elasticity * price_change)


def revenue_after(demand: Column, fare: Column, price_change: Column, elasticity: Column) -> Column:
    """Revenue at the new price, from the demand left at that price."""
    return demand_after(demand, price_change, elasticity) * (fare * (1.0 + price_change))


def cost_ratio(new_demand: Column, demand: Column) -> Column:
    """Costs follow demand; unchanged where there was no demand."""
    return F.when(demand > 0, F.try_divide(new_demand, demand)).otherwise(F.lit(1.0))
