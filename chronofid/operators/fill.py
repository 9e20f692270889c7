"""Filling gaps of ordered rows: carry, interpolation, means and modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.operators.ordered import ordered, same_keys


def carry_forward(df: DataFrame, keys: list[str], order: list[str], cols: list[str], rows: int | None = None) -> DataFrame:
    """Last known value at or before each row."""
    out = ordered(df, keys, order, rows).previous_known(**{f"_f_{c}": c for c in cols})
    return _take(out.result(), cols, "_f_")


def carry_both(df: DataFrame, keys: list[str], order: list[str], cols: list[str], rows: int | None = None) -> DataFrame:
    """Last known value, or the next one before the first."""
    out = ordered(df, keys, order, rows)
    out = out.previous_known(**{f"_f_{c}": c for c in cols}).next_known(**{f"_b_{c}": c for c in cols})
    filled = {c: F.coalesce(f"_f_{c}", f"_b_{c}") for c in cols}
    return out.result().withColumns(filled).drop(*[f"_{p}_{c}" for c in cols for p in "fb"])


def carry_edges(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], rows: int | None = None, inner: str | None = None
) -> DataFrame:
    """Fill before the first and after the last known value only; inner gaps stay.

    Where the boolean column ``inner`` holds, inner gaps take the last known value.
    """
    out = ordered(df, keys, order, rows)
    out = out.previous_known(**{f"_f_{c}": c for c in cols}).next_known(**{f"_b_{c}": c for c in cols})
    carry = F.lit(False) if inner is None else F.col(inner)

    def edge(c: str) -> Column:
        before, after = F.col(f"_f_{c}"), F.col(f"_b_{c}")
        return F.when(before.isNull(), after).when(after.isNull() | carry, before).otherwise(F.col(c))

    return out.result().withColumns({c: edge(c) for c in cols}).drop(*[f"_{p}_{c}" for c in cols for p in "fb"])


def interpolate(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], at: str | None = None, rows: int | None = None
) -> DataFrame:
    """Linear interpolation between known neighbours by row position, or by the numeric column ``at``.

    Both edges hold the nearest known value.
    """
    out = ordered(df, keys, order, rows)
    if at is None:
        out = out.numbered("_at")
    else:
        out = out.with_columns(_at=F.col(at).cast("double"))
    out = out.with_columns(
        **{f"_p_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("x"), F.col(c).cast("double").alias("y")))
           for c in cols}
    )
    out = out.previous_known(**{f"_f_{c}": f"_p_{c}" for c in cols}).next_known(**{f"_b_{c}": f"_p_{c}" for c in cols})

    def between(c: str) -> Column:
        a, b = F.col(f"_f_{c}"), F.col(f"_b_{c}")
        slope = (b["y"] - a["y"]) / (b["x"] - a["x"])
        return (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(a.isNull(), b["y"])
            .when(b.isNull(), a["y"])
            .otherwise(a["y"] + slope * (F.col("_at") - a["x"]))
        )

    helper = [f"_{p}_{c}" for c in cols for p in "pfb"]
    return out.result().withColumns({c: between(c) for c in cols}).drop("_at", *helper)


def fill_group_mean(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Fill with the mean of the group, aggregated first and joined back."""
    means = df.groupBy(*group).agg(*[F.avg(c).alias(f"_m_{c}") for c in cols])
    joined = df.alias("l").join(means.alias("r"), same_keys("l", "r", group), "left")
    joined = joined.select("l.*", *[F.col(f"r._m_{c}") for c in cols])
    return joined.withColumns({c: F.coalesce(c, f"_m_{c}") for c in cols}).drop(*[f"_m_{c}" for c in cols])


def modes(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest on ties.

    Counts per value first: ``mode`` itself would hold all of a hot key's values in one buffer.
    """
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min_by(F.col(c), F.struct(-F.col("_n"), F.col(c)))
    return counts.groupBy(*keys).agg(best.alias(c))


def _take(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    return df.withColumns({c: F.col(f"{prefix}{c}") for c in cols}).drop(*[f"{prefix}{c}" for c in cols])
