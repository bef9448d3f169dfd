"""Attaching aggregate values to rows, and exact quantiles at any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faregrid.storage import staged


# Rows of per-group values that may go to every executor, some MB; more are joined by shuffle.
BROADCAST_GROUPS = 50_000
# Parts a bracket of values is cut into before its ranks are placed.
CELLS = 1024


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``stats`` to every row of ``df``.

    Without ``by``, ``stats`` has one row and becomes a scalar subquery: no join, and a filter on
    its values still reaches the scan. With ``by`` it has one row per group; it is written and
    counted, and up to BROADCAST_GROUPS rows go to the executors, so that the rows of ``df`` are
    not shuffled on the group.
    """
    if by:
        stats = staged(stats, "groups")
        side = F.broadcast(stats) if stats.count() <= BROADCAST_GROUPS else stats
        return df.join(side, list(by), "left")
    one = stats.select(F.struct(*stats.columns).alias("one")).scalar()
    return df.withColumn("_one", one).select(*df.columns, "_one.*")


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, tuple[str, float]],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Linearly interpolated quantiles, exact, with bounded state per task.

    ``wanted`` maps result names to (column, probability). ``percentile`` keeps
    every distinct value of a group in one buffer. Here a sketch gives a narrow
    bracket around each wanted rank, a second pass counts what lies below it,
    and only rows inside a bracket are kept, as counts of values. A bracket is cut
    into CELLS ranges whose totals say where the ranks lie, so only those cells
    are sorted. Where the sketch missed, the bracket widens to the minimum or maximum, so the
    result does not depend on the sketch's error. Three passes serve all wanted quantiles.
    """
    by, probes = list(by), list(wanted.values())
    columns = list(dict.fromkeys(column for column, _ in probes))
    value = [f"_v{columns.index(column)}" for column, _ in probes]
    rows = df.selectExpr(*[f"`{b}`" for b in by], *[f"cast(`{c}` as double) as _v{j}" for j, c in enumerate(columns)])

    # One sketch per column gives the bracket edges of all its probes.
    margin = 2.0 / accuracy
    edges: list[list[str]] = [[] for _ in columns]
    low_at, high_at = [], []
    for column, p in probes:
        j = columns.index(column)
        low_at.append(f"_edges{j}[{len(edges[j])}]")
        high_at.append(f"_edges{j}[{len(edges[j]) + 1}]")
        edges[j] += [f"{max(p - margin, 0.0)!r}D", f"{min(p + margin, 1.0)!r}D"]
    sketch = rows.groupBy(*by).agg(
        *[F.expr(f"{side}(_v{j}) as _{side}{j}") for j in range(len(columns)) for side in ("min", "max")],
        *[
            F.expr(f"percentile_approx(_v{j}, array({', '.join(edges[j])}), {accuracy}) as _edges{j}")
            for j in range(len(columns))
        ],
    )

    counts = [f"count(_v{j}) as _n{j}" for j in range(len(columns))]
    counts += [f"max(_{side}{j}) as _{side}{j}" for j in range(len(columns)) for side in ("min", "max")]
    for i, v in enumerate(value):
        counts += [
            f"count_if({v} < {low_at[i]}) as _below{i}",
            f"count_if({v} <= {high_at[i]}) as _upto{i}",
            f"max({low_at[i]}) as _low{i}",
            f"max({high_at[i]}) as _high{i}",
        ]
    counted = attach(rows, sketch, by).groupBy(*by).agg(*[F.expr(c) for c in counts])

    brackets = []
    for i, (column, p) in enumerate(probes):
        j = columns.index(column)
        target = f"((_n{j} - 1) * {float(p)!r}D)"
        first = f"floor({target})"
        last = f"least({first} + 1, _n{j} - 1)"
        brackets.append(
            f"""named_struct('probe', {i},
                'low', if(_below{i} <= {first}, _low{i}, _min{j}),
                'high', if(_upto{i} > {last}, _high{i}, _max{j}),
                'before', if(_below{i} <= {first}, _below{i}, 0L),
                'first', {first}, 'last', {last}, 'weight', {target} - {first}) as _p{i}"""
        )
    inside = attach(rows, counted.selectExpr(*[f"`{b}`" for b in by], *brackets), by)
    hits = [f"{v} between _p{i}.low and _p{i}.high" for i, v in enumerate(value)]
    pairs = ", ".join(f"if({hit}, named_struct('p', _p{i}, 'v', {value[i]}), null)" for i, hit in enumerate(hits))
    values = (
        inside.where(" or ".join(hits))
        .selectExpr(*[f"`{b}`" for b in by], f"explode(array_compact(array({pairs}))) as h")
        .groupBy(*by, F.col("h.p").alias("p"), F.col("h.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    share = "nanvl((v - p.low) / (p.high - p.low), 0D)"
    values = values.withColumn("cell", F.expr(f"if(p.high > p.low, cast(least(floor({share} * {CELLS}), {CELLS - 1}) as int), 0)"))
    values = staged(values, "bracket-values")
    cells = values.groupBy(*by, F.col("p.probe").alias("probe"), "cell").agg(F.sum("c").alias("size"), F.first("p").alias("p"))
    upto = F.sum("size").over(Window.partitionBy(*by, "probe").orderBy("cell"))  # CELLS rows a probe at most
    cells = cells.withColumn("below", F.col("p.before") + upto - F.col("size"))
    holds = " or ".join(f"(below <= p.{rank} and p.{rank} < below + size)" for rank in ("first", "last"))
    cells = cells.where(holds).select(*by, "probe", "cell", "below")
    running = Window.partitionBy(*by, "p.probe", "cell").orderBy("v")
    same = (F.col("v.p.probe") == F.col("k.probe")) & (F.col("v.cell") == F.col("k.cell"))
    for b in by:
        same = same & F.col(f"v.`{b}`").eqNullSafe(F.col(f"k.`{b}`"))
    found = values.alias("v").join(F.broadcast(cells).alias("k") if not by else cells.alias("k"), same)
    placed = found.select(*[F.col(f"v.`{b}`").alias(b) for b in by], "p", "v.cell", F.col("v.v").alias("v"), "c", "below")
    placed = placed.withColumn("stop", F.col("below") + F.sum("c").over(running))

    picks = []
    for i in range(len(probes)):
        for rank in ("first", "last"):
            covers = f"p.probe = {i} and stop - c <= p.{rank} and p.{rank} < stop"
            picks.append(f"max(if({covers}, v, null)) as _{rank}{i}")
        picks.append(f"max(if(p.probe = {i}, p.weight, null)) as _weight{i}")
    picked = placed.groupBy(*by).agg(*[F.expr(pick) for pick in picks])
    return picked.selectExpr(
        *[f"`{b}`" for b in by],
        *[f"_first{i} + (_last{i} - _first{i}) * _weight{i} as `{name}`" for i, name in enumerate(wanted)],
    )


def value_count_quantile(df: DataFrame, value: str, prob: float) -> DataFrame:
    """Quantile of a column with few distinct values, from its value counts."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile(F.col(value).cast("double"), F.lit(prob), F.col("n")).alias("q"))
