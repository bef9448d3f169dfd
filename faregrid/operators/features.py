"""Lags, rolling means and exponential averages of a series.

All windows look back a bounded number of rows, so they run over blocks of
positions (see ``plans.positions``) and no task holds a whole zone.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.params import DEFAULTS, Params
from faregrid.plans.positions import block_window, in_blocks, out_of_blocks, with_positions

# Largest logarithm of a weight inside one block; doubles end near 709.
MAX_LOG_WEIGHT = 600.0
BLOCK_ROWS = 4096


def ema_memory(alpha: float, negligible: float = DEFAULTS.ema_negligible) -> int:
    """Rows after which an exponential weight is negligible."""
    if not 0.0 < alpha < 1.0:
        raise ValueError("the smoothing factor must lie between 0 and 1")
    return ceil(log(negligible) / log(1.0 - alpha))


def ema_block(alpha: float, negligible: float = DEFAULTS.ema_negligible) -> int:
    """Rows of a block, so that no weight in block and halo leaves the doubles."""
    fits = floor(MAX_LOG_WEIGHT / -log(1.0 - alpha)) - ema_memory(alpha, negligible)
    return max(1, min(max(BLOCK_ROWS, ema_memory(alpha, negligible)), fits))


def lag_columns(target: str, n_lags: int, window) -> dict[str, Column]:
    return {f"ft_{k}": F.lag(target, k).over(window) for k in range(1, n_lags + 1)}


def with_running(df: DataFrame, target: str, window) -> DataFrame:
    """Sum and number of the known values before each row of a block, which :func:`rolling_columns` reads.

    Values that aren't finite are counted apart, so that they don't outlive their windows.
    """
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    x = F.col(target)
    odd = x.isNotNull() & ~(F.abs(x.cast("double")) < float("inf"))
    parts = {
        "_sum_before": F.sum(F.when(~odd, x)),
        "_n_before": F.count(x),
        "_odd_before": F.count_if(odd),
    }
    return df.withColumns({name: F.coalesce(part.over(before), F.lit(0)) for name, part in parts.items()})


def rolling_columns(windows: Sequence[int], window) -> dict[str, Column]:
    """Means of the previous rows, the current one excluded.

    Differences of the running sums of :func:`with_running`: the cost of a row doesn't grow with the
    window. Sums of whole numbers are exact; with fractions a mean of w rows is off by at most
    2 ** -53 times the rows of a block and halo times the sum of the absolute values in them, over w.
    The mean of a window that holds NaN or an infinite value is NaN.
    """

    def since(name: str, w: int) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, w).over(window), F.lit(0))

    def mean(w: int) -> Column:
        plain = F.try_divide(since("_sum_before", w).cast("double"), since("_n_before", w).cast("double"))
        return F.when(since("_odd_before", w) > 0, F.lit(float("nan"))).otherwise(plain)

    return {f"rolling_avg_{w}": mean(w) for w in windows}


def ema_columns(target: str, alpha: float, skip: int, window, block: Column, size: int, halo: int) -> dict[str, Column]:
    """Exponential averages of the rows before the current one.

    With weights growing as (1 - alpha) ** -j along a block, both forms are
    ratios of running sums: constant work per row, and the common factor
    cancels or is taken out at the end. ``exp_avg`` is normalised by the
    weights and starts after the first ``skip`` rows of a zone;
    ``exp_avg_recursive`` starts from the zone's first row with weight one.
    """
    decay = 1.0 - alpha
    j = (F.col("pos") - (block * F.lit(size) - F.lit(halo))).cast("double")
    weight = F.pow(F.lit(decay), -j)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(F.col("pos") > skip, weight).otherwise(F.lit(0.0))
    share = F.when(F.col("pos") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
    return {
        "exp_avg": F.try_divide(F.sum(kept * F.col(target)).over(before), F.sum(kept).over(before)),
        "exp_avg_recursive": F.sum(share * weight * F.col(target)).over(before)
        * F.pow(F.lit(decay), j - F.lit(1.0)),
    }


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in any of ``columns``."""
    return df.dropna(subset=list(columns))


def add_features(
    series: DataFrame,
    zone: str = "cluster_id",
    bins: str = "time_bin",
    target: str = "demand",
    p: Params = DEFAULTS,
    previous: Sequence[str] = (),
) -> DataFrame:
    """All lags, rolling means and both exponential averages, on every row.

    ``previous`` names further columns whose value on the preceding row is
    added as ``prev_<name>``. One pass: positions, blocks, windows.
    """
    return placed_features(with_positions(series, [zone], bins), zone, target, p, previous)


def look_back_rows(p: Params = DEFAULTS) -> int:
    """Rows of a zone before a row that can change its features beyond rounding."""
    return max(ema_memory(p.ema_alpha, p.ema_negligible), p.n_lags, max(p.rolling_windows, default=1), 1)


def placed_features(
    placed: DataFrame, zone: str = "cluster_id", target: str = "demand", p: Params = DEFAULTS, previous: Sequence[str] = ()
) -> DataFrame:
    """:func:`add_features` of rows that have their ``pos`` in the zone.

    A zone's first rows may be missing: rows with :func:`look_back_rows` rows before them get what all rows give.
    """
    memory, room = ema_memory(p.ema_alpha, p.ema_negligible), ema_block(p.ema_alpha, p.ema_negligible)
    look_back = max(p.n_lags, max(p.rolling_windows, default=1), 1)
    window = block_window([zone])

    def averages(size: int, halo: int) -> dict[str, Column]:
        return ema_columns(target, p.ema_alpha, p.n_lags, window, F.col("_block"), size, halo)

    others = {
        **lag_columns(target, p.n_lags, window),
        **rolling_columns(p.rolling_windows, window),
        **{f"prev_{name}": F.lag(name, 1).over(window) for name in previous},
    }
    running = ("_sum_before", "_n_before", "_odd_before")

    def blocks(df: DataFrame, size: int, halo: int) -> DataFrame:
        return with_running(in_blocks(df, size, halo), target, window)

    # One pass where the look-back of the windows fits the averages' blocks, else one each.
    halo = max(memory, look_back)
    size = min(max(BLOCK_ROWS, halo), room + memory - halo)
    if size >= halo:
        return out_of_blocks(blocks(placed, size, halo).withColumns(others | averages(size, halo))).drop(*running)
    averaged = out_of_blocks(in_blocks(placed, room, min(memory, room)).withColumns(averages(room, min(memory, room))))
    return out_of_blocks(blocks(averaged, max(BLOCK_ROWS, look_back), look_back).withColumns(others)).drop(*running)


def main_features(series: DataFrame, p: Params = DEFAULTS, previous: Sequence[str] = ()) -> DataFrame:
    """Lags, incomplete rows dropped, then the normalised average.

    The average starts again after the drop, so it is NULL on the first kept
    row of a zone, which stays.
    """
    names = [f"ft_{k}" for k in range(1, p.n_lags + 1)]
    extra = [f"prev_{name}" for name in previous]
    full = add_features(series, p=p, previous=previous)
    return _complete(full.select(*series.columns, "pos", *names, "exp_avg", *extra), [*series.columns, *names])


def library_features(series: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Lags, rolling means and the recursive average, then incomplete rows dropped."""
    names = [f"ft_{k}" for k in range(1, p.n_lags + 1)]
    names += [f"rolling_avg_{w}" for w in p.rolling_windows]
    full = add_features(series, zone="pickup_cluster", bins="pickup_bins", p=p)
    kept = full.select(*series.columns, *names, F.col("exp_avg_recursive").alias("exp_avg"))
    return _complete(kept, kept.columns)
