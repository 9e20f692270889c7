"""Two-sample distances between real and synthetic rows of one ``is_synth`` frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofid.operators.ordered import Ordered, ordered, same_keys
from chronofid.session import segment_rows

SYNTH = "is_synth"
#: Groups whose buffers a task holds before Spark sorts instead (spark.sql.objectHashAggregate.sortBased.fallbackThreshold).
GROUPS_HELD = 128


def real_count(weight: Column | None = None) -> Column:
    return F.sum(F.when(~F.col(SYNTH), F.lit(1) if weight is None else weight).otherwise(0)).cast("long")


def synth_count(weight: Column | None = None) -> Column:
    return F.sum(F.when(F.col(SYNTH), F.lit(1) if weight is None else weight).otherwise(0)).cast("long")


def with_totals(cells: DataFrame, keys: list[str], **totals: str) -> DataFrame:
    """Attach per-key sums without gathering a key's cells in one task: aggregate, then join."""
    sums = cells.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in totals.items()])
    if not keys:
        return cells.join(F.broadcast(sums), F.lit(True), "left")  # one row
    joined = cells.alias("l").join(sums.alias("r"), same_keys("l", "r", keys), "inner")
    return joined.select("l.*", *[F.col(f"r.{n}") for n in totals])


def ordered_totals(steps: Ordered, **totals: str) -> DataFrame:
    """Per-key sums next to ordered rows: the same window if no key is cut, a join otherwise."""
    if steps.split:
        return with_totals(steps.result(), steps.keys, **totals)
    whole = Window.partitionBy(*steps.keys)
    return steps.result().withColumns({n: F.sum(c).over(whole) for n, c in totals.items()})


def value_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Rows per distinct non-null value and side; duplicates collapse before the shuffle."""
    w = None if weight is None else F.col(weight)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(real_count(w).alias("real_n"), synth_count(w).alias("synth_n"))
    )


def side_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, real_n, synth_n``: rows of either side per key."""
    return df.groupBy(*keys).agg(real_count().alias("real_n"), synth_count().alias("synth_n"))


def ecdf_distances(
    counts: DataFrame, keys: list[str], value: str, rows: int | None = None, kept: bool = False
) -> DataFrame:
    """KS statistic and Wasserstein-1 distance per key from ``value_counts`` output (``kept``: a checkpoint).

    Both are null where one side has no value.
    """
    steps = ordered(counts, keys, [value], rows, kept).running(real_c="real_n", synth_c="synth_n")
    steps = steps.lead(next_value=value)
    cells = ordered_totals(steps, n_real="real_n", n_synth="synth_n")
    gap = F.abs(F.try_divide("real_c", "n_real") - F.try_divide("synth_c", "n_synth"))
    width = F.col("next_value") - F.col(value)
    return cells.groupBy(*keys).agg(
        F.max("n_real").alias("n_real"),
        F.max("n_synth").alias("n_synth"),
        F.max(gap).alias("ks"),
        F.sum(gap * F.coalesce(width, F.lit(0.0))).alias("w1"),
    )


def ks_by(df: DataFrame, keys: list[str], value: str, rows: int | None = None) -> DataFrame:
    """KS statistic of ``value`` between the two sides, per key."""
    return ecdf_distances(value_counts(df, keys, value), keys, value, rows)


def tvd_by(df: DataFrame, keys: list[str], cats: list[str]) -> DataFrame:
    """Total-variation distance of the joint categories ``cats`` per key; nulls form a category.

    Drop null rows first where they should not count. Null where one side is empty.
    """
    return cell_distances(side_counts(df, [*keys, *cats]), keys)


def cell_distances(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Total-variation distance per key from cells with ``real_n`` and ``synth_n``."""
    cells = with_totals(cells, keys, n_real="real_n", n_synth="synth_n")
    gap = F.abs(F.try_divide("real_n", "n_real") - F.try_divide("synth_n", "n_synth"))
    return cells.groupBy(*keys).agg(
        F.max("n_real").alias("n_real"),
        F.max("n_synth").alias("n_synth"),
        (F.sum(gap) * 0.5).alias("tvd"),
    )


def small_groups(df: DataFrame, keys: list[str], rows: int) -> bool:
    """Whether the values of whole groups fit in aggregation buffers.

    They do if all ``rows`` are one segment at most. Of larger inputs no group may have more than the share of a segment that
    lets as many groups as a task holds at a time (before it sorts) stay within one segment.
    """
    limit = segment_rows(df.sparkSession)
    if rows <= limit:
        return True
    if not keys:
        return False
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return most is None or most <= limit // GROUPS_HELD


def medians(df: DataFrame, keys: list[str], cols: dict[str, str], rows: int) -> DataFrame:
    """Exact medians per key, ``name=source``; nulls are skipped.

    ``median`` keeps a group's values in one aggregation buffer, so it only serves small groups.
    Larger ones count values and pick the middle ranks instead.
    """
    if small_groups(df, keys, rows):
        return df.groupBy(*keys).agg(*[F.median(c).alias(n) for n, c in cols.items()])
    return counted_medians(df, keys, cols, rows)


def counted_medians(df: DataFrame, keys: list[str], cols: dict[str, str], rows: int) -> DataFrame:
    """``medians`` of groups of any size, from counted values."""
    sources = list(cols.items())
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(n).alias("_name"), F.col(c).cast("double").alias("_value")) for n, c in sources
    ])).alias("_x")).select(*keys, "_x.*")
    group = [*keys, "_name"]
    counts = long.where(F.col("_value").isNotNull()).groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_totals(ordered(counts, group, ["_value"], rows * len(sources)).running(_upto="_n"), _total="_n")
    before = F.col("_upto") - F.col("_n")
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = [F.max(F.when((before < p) & (F.col("_upto") >= p), F.col("_value"))) for p in (low, high)]
    picked = ranked.groupBy(*group).agg(((middle[0] + middle[1]) / 2).alias("_median"))
    wide = picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n, _ in sources]
    )
    if not keys:
        return wide
    every = df.select(*keys).distinct()
    return every.alias("l").join(wide.alias("r"), same_keys("l", "r", keys), "left").select(
        "l.*", *[F.col(f"r.{n}") for n, _ in sources]
    )


def weighted_medians(df: DataFrame, keys: list[str], value: str, weight: str, rows: int | None = None) -> DataFrame:
    """Exact median per key where each row stands for ``weight`` equal rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_n"))
    ranked = ordered_totals(ordered(counts, keys, [value], rows).running(_upto="_n"), _total="_n")
    before = F.col("_upto") - F.col("_n")
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = [F.max(F.when((before < p) & (F.col("_upto") >= p), F.col(value))) for p in (low, high)]
    return ranked.groupBy(*keys).agg(((middle[0] + middle[1]) / 2).alias("median"))
