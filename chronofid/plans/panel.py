"""Entity-by-time panels in long form: one row per entity, real time point and channel set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.functions.numeric import to_double
from chronofid.operators import fill
from chronofid.operators.distributions import SYNTH
from chronofid.operators.grid import unrolled
from chronofid.operators.ordered import ordered
from chronofid.operators.sampling import first_rows
from chronofid.plans.roles import TableRoles

FILLS = ["none", "edge_nearest", "interpolate", "ffill", "tsmean", "crossmean", "entitymean", "zero"]


def time_index(pair: DataFrame, time: str) -> DataFrame:
    """Distinct real times with their zero-based position ``time_ix``."""
    times = pair.where(~F.col(SYNTH) & F.col(time).isNotNull()).select(time).distinct()
    return ordered(times, [], [time], pair.count()).numbered("time_ix").result()


def align(
    pair: DataFrame,
    roles: TableRoles,
    fill_method: str = "edge_nearest",
    fill_value: float = 0.0,
    index: DataFrame | None = None,
    width: int | None = None,
) -> DataFrame:
    """Each entity of each side on every real time point: ``(is_synth, key, time_ix, channels)``.

    The result has entities times time points rows by definition; each entity unrolls its own positions
    in chunks, and only the number of time points is known to the driver.
    """
    if fill_method not in FILLS:
        raise ValueError(f"fill_method must be one of {FILLS}, not {fill_method!r}")
    key, time, cols = roles.key, roles.time, roles.num_cols
    index = time_index(pair, time) if index is None else index
    width = index.count() if width is None else width
    known = pair.where(F.col(key).isNotNull()).select(SYNTH, key, time, roles.row, *[to_double(c).alias(c) for c in cols])
    unique = first_rows(known, [SYNTH, key, time], roles.row).drop(roles.row)
    entities = known.select(SYNTH, key).distinct()
    slots = unrolled(entities, [SYNTH, key], F.lit(width - 1), "time_ix")
    placed = unique.join(index, time, "inner").drop(time)
    grid = slots.join(placed, [SYNTH, key, "time_ix"], "left")
    group, order = [SYNTH, key], ["time_ix"]
    if fill_method == "edge_nearest":
        # Where a side's input repeats a cell, its inner gaps are carried as well.
        cells = known.groupBy(SYNTH, key, time).agg(F.count(F.lit(1)).alias("n"))
        repeated = cells.groupBy(SYNTH).agg((F.max("n") > 1).alias("_inner"))
        # One row per side: dealt by side, the grid would meet it in two tasks.
        grid = fill.carry_edges(grid.join(F.broadcast(repeated), SYNTH), group, order, cols, width, inner="_inner").drop("_inner")
    elif fill_method == "ffill":
        grid = fill.carry_both(grid, group, order, cols, width)
    elif fill_method == "interpolate":
        kind = pair.schema[time].dataType.typeName()
        moment = F.unix_micros(F.col(time).cast("timestamp")) if kind.startswith(("timestamp", "date")) else F.col(time)
        clock = index.select("time_ix", moment.cast("double").alias("_clock"))
        grid = fill.interpolate(grid.join(clock, "time_ix"), group, order, cols, "_clock", width).drop("_clock")
    elif fill_method in ("tsmean", "crossmean"):
        grid = fill.fill_group_mean(grid, [SYNTH, "time_ix"], cols)
    elif fill_method == "entitymean":
        grid = fill.fill_group_mean(grid, group, cols)
    if fill_method == "none":
        return grid
    return grid.withColumns({c: F.coalesce(c, F.lit(fill_value)) for c in cols})


def channels(grid: DataFrame, roles: TableRoles) -> DataFrame:
    """Long panel: one row per entity, time point and channel."""
    return grid.unpivot([SYNTH, roles.key, "time_ix"], roles.num_cols, "channel", "value")
