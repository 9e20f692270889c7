"""Reproducible draws, splits and de-duplication. Draws follow an MD5 of seed and id."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofid.operators.ordered import ordered


def draw(ids: list[str], seed: int | Column) -> Column:
    """Pseudo-random order key of a row, the same on every run and engine."""
    text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", text, *[F.col(c).cast("string") for c in ids]))


def sample_entities(df: DataFrame, keys: list[str], n: int | None, seed: int) -> DataFrame:
    """Rows of ``n`` drawn entities, all rows if ``n`` is None or not positive."""
    if n is None or n <= 0:
        return df
    entities = df.select(*keys).distinct()
    chosen = entities.orderBy(draw(keys, seed), *keys).limit(n)
    return df.join(chosen, keys, "left_semi")


def stratified_position(df: DataFrame, label: str, ids: list[str], seed: int) -> DataFrame:
    """Adds ``_pos``, the drawn zero-based position within the label, and ``_size`` of the label."""
    drawn = df.withColumn("_draw", draw(ids, seed))
    placed = ordered(drawn, [label], ["_draw", *ids]).numbered("_pos").result()
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    return placed.join(sizes, placed[label].eqNullSafe(sizes[label]), "left").drop(sizes[label]).drop("_draw")


def seeded_positions(df: DataFrame, label: str, ids: list[str], seeds: Iterable[int]) -> DataFrame:
    """``seed, label, ids, _pos, _size``: ``stratified_position`` for each of several seeds in one job, without other columns."""
    each = df.select(label, *ids).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = each.withColumn("_draw", draw(ids, F.col("seed")))
    placed = ordered(drawn, ["seed", label], ["_draw", *ids]).numbered("_pos").result().drop("_draw")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    return placed.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).drop("_label")


def stratified_split(df: DataFrame, label: str, ids: list[str], seed: int, test_ratio: float = 0.2) -> DataFrame:
    """Adds ``is_test``: each label gives the same share of its rows to the test part."""
    placed = stratified_position(df, label, ids, seed)
    cut = F.rint(F.col("_size") * test_ratio)
    return placed.withColumn("is_test", F.col("_pos") < cut).drop("_pos", "_size")


def stratified_folds(df: DataFrame, label: str, ids: list[str], seed: int, folds: int = 5) -> DataFrame:
    """Adds ``fold``: each label spreads evenly over the folds."""
    placed = stratified_position(df, label, ids, seed)
    return placed.withColumn("fold", (F.col("_pos") % folds).cast("int")).drop("_pos", "_size")


def first_rows(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """First row per key in source order.

    Spark filters ``row_number() = 1`` on the map side before the shuffle, so copies of a hot key
    never travel.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(row))
    return df.withColumn("_rn", place).where("_rn = 1").drop("_rn")
