"""Business and modelling parameters.

The defaults are fixed values: results only agree with the published figures
when these bounds, rates and thresholds are used.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Range:
    low: float
    high: float


@dataclass(frozen=True)
class Params:
    # Cleaning bounds.
    distance_miles: Range = Range(0.0, 23.0)
    trip_minutes: Range = Range(1.0, 720.0)
    speed_mph: Range = Range(0.0, 45.31)
    amount: Range = Range(0.0, 1000.0)
    box_latitude: Range = Range(40.5774, 40.9176)
    box_longitude: Range = Range(-74.15, -73.7004)

    # Calendar.
    rush_hours: tuple[int, ...] = (7, 8, 9, 16, 17, 18, 19)
    bin_seconds: int = 600

    # Series features.
    n_lags: int = 5
    rolling_windows: tuple[int, ...] = (7, 30)
    ema_alpha: float = 0.3
    # Weights below this do not change a double; older rows are left out.
    ema_negligible: float = 1e-17

    # Chronological split.
    train_ratio: float = 0.7
    validation_ratio: float = 0.15

    # Clustering.
    n_clusters: int = 40
    seed: int = 42

    # Cost stack, as shares of revenue.
    driver_share: float = 0.65
    processing_share: float = 0.029
    operations_share: float = 0.05
    elasticity: float = -0.5

    # Peer benchmarks.
    high_impact_quantile: float = 0.60
    min_high_impact_zones: int = 5
    min_peers: int = 2
    benchmark_quantile: float = 0.75
    underperforming_below: float = 0.90
    target_of_benchmark: float = 0.95
    max_opportunities: int = 3
    max_inefficient: int = 2
    feed_size: int = 3

    # Share of the gain an action is expected to reach, per anomaly type.
    opportunity_reach: float = 0.30
    efficiency_reach: float = 0.40
    low_revenue_reach: float = 0.15
    demand_boost_reach: float = 0.20

    # Alerts.
    revenue_variance: float = 0.20
    interval_width: float = 0.30

    # Recommendations.
    surge_quantile: float = 0.75
    surge_change: float = 0.15
    surge_rows: int = 3
    discount_quantile: float = 0.25
    discount_change: float = -0.10
    discount_rows: int = 2
    healthy_margin: float = 0.20
    confident_demand: float = 10.0
    reallocation_factor: float = 2.0
    reallocated_trips: float = 2.0
    cost_rows: int = 2
    cost_saving: float = 0.20
    weekend_uplift: float = 0.10
    price_increase_quantile: float = 0.60
    price_increase_margin: float = 0.25
    price_increase: float = 0.10

    # Text chunks and retrieval.
    chunk_size: int = 600
    chunk_overlap: int = 150
    min_chunk_chars: int = 50
    retrieve_k: int = 3


DEFAULTS = Params()
