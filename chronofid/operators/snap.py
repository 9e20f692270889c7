"""Nearest-point and as-of lookups against a grid of time points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.operators.ordered import ordered

_X = "_x"


def _number(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    if kind == "date" or kind.startswith("timestamp"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    return F.col(c).cast("double")


def neighbours(values: DataFrame, grid: DataFrame, time: str, rows: int | None = None) -> DataFrame:
    """For each distinct value: the grid rows at or before and at or after it, as structs.

    Values and grid are merged into one order and neighbours are carried along it, so neither side has
    to fit on an executor. ``grid`` holds distinct times; its further columns ride along. ``rows`` bounds
    both sides together.
    """
    here = F.struct(_number(grid, time).alias("x"), F.col(time).alias("g"), *[c for c in grid.columns if c != time])
    points = grid.where(F.col(time).isNotNull()).select(
        _number(grid, time).alias(_X), here.alias("_at"), F.lit(None).cast(values.schema[time].dataType).alias("_v")
    )
    probes = values.where(F.col(time).isNotNull()).select(
        _number(values, time).alias(_X), F.lit(None).cast(points.schema["_at"].dataType).alias("_at"), F.col(time).alias("_v")
    )
    merged = points.unionByName(probes).groupBy(_X).agg(F.max("_at").alias("_at"), F.max("_v").alias("_v"))
    out = ordered(merged, [], [_X], rows).previous_known(_before="_at").next_known(_after="_at").result()
    return out.where(F.col("_v").isNotNull()).select(
        F.col("_v").alias(time), F.col(_X).alias("x"), F.col("_before").alias("before"), F.col("_after").alias("after")
    )


def nearest(df: DataFrame, grid: DataFrame, time: str, end: str | None = None) -> DataFrame:
    """Move each time to the nearest grid point, the earlier one on ties; rows without a time are dropped.

    A numeric ``end`` column moves by the same amount. The lookup runs on distinct times and is joined
    back, so the other columns are not sorted.
    """
    rows = df.count() + grid.count()
    near = neighbours(df.select(time).distinct(), grid.select(time).distinct(), time, rows)
    before, after = F.col("before"), F.col("after")
    earlier = after.isNull() | (F.col("x") - before["x"] <= after["x"] - F.col("x"))
    chosen = F.when(before.isNotNull() & earlier, before["g"]).otherwise(after["g"])
    moves = near.select(time, chosen.alias("_snapped"))
    moved = df.join(moves, time, "inner")
    if end is not None:
        shift = F.col("_snapped").cast("double") - F.col(time).cast("double")
        moved = moved.withColumn(end, F.col(end).cast("double") + shift)
    return moved.withColumn(time, F.col("_snapped")).drop("_snapped").select(*df.columns)


def to_step(c: str | Column, step: int | float, anchor: int | float = 0) -> Column:
    """Round to ``anchor + k * step``, half to even."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return (F.rint((x - anchor) / step) * step + anchor).cast("long")
