"""Static column fidelity: each score looks at whole columns, without regard to time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.functions.labels import whole_label
from chronofid.operators.contingency import pair_distances
from chronofid.operators.distributions import SYNTH, cell_distances, counted_medians, ecdf_distances, ks_by, side_counts, small_groups, tvd_by
from chronofid.operators.moments import pair_correlations
from chronofid.operators.shape import (
    FEATURE,
    VALUE,
    column_pairs,
    distinct_counts,
    unpivot_labels,
    unpivot_numbers,
)
from chronofid.plans.metrics import Scan, evaluate, metric
from chronofid.plans.roles import TableRoles, union_all

STATISTICS = ["mean", "median", "std", "min", "max"]


def category_label(df: DataFrame, c: str) -> Column:
    """Category text; floats that are whole lose their decimals."""
    floating = df.schema[c].dataType.typeName() in ("float", "double")
    return whole_label(c) if floating else F.col(c).cast("string")


def labels(pair: DataFrame, cats: list[str]) -> DataFrame:
    return pair.withColumns({c: category_label(pair, c) for c in cats})


def _both(score: Column) -> Column:
    return F.when((F.col("n_real") > 0) & (F.col("n_synth") > 0), score).alias("score")


def ks_complement(pair: DataFrame, nums: list[str]) -> DataFrame:
    n = pair.count() * len(nums)
    ks = ks_by(unpivot_numbers(pair, [SYNTH], nums), [FEATURE], VALUE, n)
    return ks.select(FEATURE, _both(1 - F.col("ks")))


def tv_complement(pair: DataFrame, cats: list[str]) -> DataFrame:
    long = unpivot_labels(labels(pair, cats), [SYNTH], cats).where(F.col(VALUE).isNotNull())
    return tvd_by(long, [FEATURE], [VALUE]).select(FEATURE, _both(1 - F.col("tvd")))


def statistic_similarity(pair: DataFrame, nums: list[str]) -> DataFrame:
    """One minus the relative difference of the means."""
    means = unpivot_numbers(pair, [SYNTH], nums).groupBy(FEATURE).agg(
        F.avg(F.when(~F.col(SYNTH), F.col(VALUE))).alias("real"),
        F.avg(F.when(F.col(SYNTH), F.col(VALUE))).alias("synth"),
    )
    return _mean_gap(means)


def mean_similarity(counts: DataFrame) -> DataFrame:
    """``statistic_similarity`` from counted values."""
    return _mean_gap(counts.groupBy(FEATURE).agg(
        *[F.try_divide(F.sum(F.col(VALUE) * F.col(f"{side}_n")), F.sum(f"{side}_n")).alias(side) for side in ("real", "synth")]
    ))


def _mean_gap(means: DataFrame) -> DataFrame:
    scale = F.greatest(F.abs("real"), F.abs("synth")) + 1e-6
    known = F.col("real").isNotNull() & F.col("synth").isNotNull()
    return means.select(FEATURE, F.when(known, 1 - F.abs(F.col("real") - F.col("synth")) / scale).alias("score"))


def seen_categories(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of real categories and how many of them the synthetic side has too."""
    return seen_cells(side_counts(long.where(F.col(VALUE).isNotNull()), [*keys, VALUE]), keys)


def seen_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``seen_categories`` from counted categories."""
    real, synth = F.col("real_n") > 0, F.col("synth_n") > 0
    return cells.groupBy(*keys).agg(F.count_if(real).alias("real"), F.count_if(real & synth).alias("shared"))


def category_coverage(pair: DataFrame, cats: list[str]) -> DataFrame:
    seen = seen_categories(unpivot_labels(labels(pair, cats), [SYNTH], cats), [FEATURE])
    return seen.select(FEATURE, F.when(F.col("real") > 0, F.col("shared") / F.col("real")).alias("score"))


def covered_share(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: share of synthetic values inside the real range; null if a side is empty."""
    known = long.where(F.col(VALUE).isNotNull())
    bounds = known.where(~F.col(SYNTH)).groupBy(*keys).agg(F.min(VALUE).alias("low"), F.max(VALUE).alias("high"))
    inside = F.col(VALUE).between(F.col("low"), F.col("high")).cast("double")
    return known.where(SYNTH).join(bounds, keys, "inner").groupBy(*keys).agg(F.avg(inside).alias("score"))


def covered_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``covered_share`` from counted values."""
    bounds = counts.where("real_n > 0").groupBy(*keys).agg(F.min(VALUE).alias("low"), F.max(VALUE).alias("high"))
    inside = F.when(F.col(VALUE).between(F.col("low"), F.col("high")), F.col("synth_n")).otherwise(0)
    covered = F.sum(inside) / F.sum("synth_n")
    return counts.where("synth_n > 0").join(bounds, keys, "inner").groupBy(*keys).agg(covered.alias("score"))


def range_coverage(pair: DataFrame, nums: list[str]) -> DataFrame:
    return covered_share(unpivot_numbers(pair, [SYNTH], nums), [FEATURE])


def correlation_similarity(pair: DataFrame, nums: list[str]) -> DataFrame:
    """One minus half the difference of the correlations; an undefined correlation counts as 0."""
    rho = pair_correlations(pair, [], column_pairs(nums))
    gap = F.abs(F.coalesce("real_rho", F.lit(0.0)) - F.coalesce("synth_rho", F.lit(0.0)))
    return rho.select(FEATURE, (1 - gap / 2).alias("score"))


def contingency_pairs(
    pair: DataFrame, cats: list[str], limit: int | None = None
) -> list[tuple[str, str]]:
    """All category pairs; with a ``limit``, those whose joint table on the real side stays within so many cells."""
    if limit is None:
        return column_pairs(cats)
    sizes = distinct_counts(pair.where(~F.col(SYNTH)), cats)
    return [(a, b) for a, b in column_pairs(cats) if sizes[a] * sizes[b] <= limit]


def contingency_similarity(pair: DataFrame, cats: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """One minus the distance of the joint category tables; a null is a category of its own."""
    pairs = contingency_pairs(pair, cats) if pairs is None else pairs
    return pair_distances(labels(pair, cats), [], pairs, nulls=True).select(FEATURE, _both(1 - F.col("tvd")))


def entity_statistics(df: DataFrame, keys: list[str], value: str, rows: int | None = None) -> DataFrame:
    """Count, mean, median, sample deviation, minimum and maximum per group; no median where a key is null."""
    rows = df.count() if rows is None else rows
    stats = [
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ]
    if not small_groups(df, keys, rows):
        return df.groupBy(*keys).agg(*stats).join(counted_medians(df, keys, {"median": value}, rows), keys, "left")
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    whole = df.groupBy(*keys).agg(*stats, F.median(value).alias("median"))
    return whole.withColumn("median", F.when(known, F.col("median")))


def statistic_msas(pair: DataFrame, key: str, value: str, stats: list[str] | None = None, n: int | None = None) -> DataFrame:
    """KS complement of a per-entity statistic, one row per statistic."""
    stats = STATISTICS if stats is None else stats
    rows = pair.withColumn(value, F.col(value).try_cast("double")).where(F.col(key).isNotNull())
    n = pair.count() if n is None else n
    per_entity = entity_statistics(rows, [SYNTH, key], value, n)
    long = unpivot_numbers(per_entity, [SYNTH], stats)
    ks = ks_by(long, [FEATURE], VALUE, n * len(stats))
    feature = F.concat(F.lit(f"{key} x {value} ["), F.col(FEATURE), F.lit("]"))
    return ks.select(feature.alias(FEATURE), _both(1 - F.col("ks")))


def suite(pair: DataFrame, nums: list[str], cats: list[str], sequences: list[tuple[str, str]] = ()) -> DataFrame:
    """All static scores of one table, one row per metric and feature. ``sequences`` are pairs of a key and a value column."""
    roles = TableRoles(key="", time="", row="", num_cols=list(nums), cat_cols=list(cats))
    scan = Scan(pair, roles, {"sequences": list(sequences), "columns": [c for both in sequences for c in both]})
    return evaluate(scan, ["static"]).drop("family")


# ---- registered scores -----------------------------------------------------------------------------


def _has_nums(scan: Scan) -> bool:
    return bool(scan.roles.num_cols)


def _has_cats(scan: Scan) -> bool:
    return bool(scan.roles.cat_cols)


def _label_counts(scan: Scan) -> DataFrame:
    return scan.label_counts(labelled=lambda df: labels(df, scan.roles.cat_cols), name="whole")


def _pairs(scan: Scan) -> list[tuple[str, str]]:
    return column_pairs(scan.roles.cat_cols)


@metric("static", "KSComplement", _has_nums)
def _ks(scan: Scan) -> DataFrame:
    ks = ecdf_distances(scan.number_counts(), [FEATURE], VALUE, scan.distinct_numbers(), kept=True)
    return ks.select(FEATURE, _both(1 - F.col("ks")))


@metric("static", "StatisticSimilarity", _has_nums)
def _means(scan: Scan) -> DataFrame:
    return mean_similarity(scan.number_counts())


@metric("static", "RangeCoverage", _has_nums)
def _range(scan: Scan) -> DataFrame:
    return covered_counts(scan.number_counts(), [FEATURE])


@metric("static", "CorrelationSim", lambda scan: len(scan.roles.num_cols) > 1)
def _correlation(scan: Scan) -> DataFrame:
    return correlation_similarity(scan.pair, scan.roles.num_cols)


@metric("static", "TVComplement", _has_cats)
def _tv(scan: Scan) -> DataFrame:
    return cell_distances(_label_counts(scan), [FEATURE]).select(FEATURE, _both(1 - F.col("tvd")))


@metric("static", "CategoryCoverage", _has_cats)
def _coverage(scan: Scan) -> DataFrame:
    seen = seen_cells(_label_counts(scan), [FEATURE])
    return seen.select(FEATURE, F.when(F.col("real") > 0, F.col("shared") / F.col("real")).alias("score"))


@metric("static", "ContingencySim", lambda scan: bool(_pairs(scan)))
def _contingency(scan: Scan) -> DataFrame:
    return contingency_similarity(scan.pair, scan.roles.cat_cols, _pairs(scan))


@metric("static", "StatisticMSAS", lambda scan: bool(scan.options.get("sequences")))
def _msas(scan: Scan) -> DataFrame:
    each = [statistic_msas(scan.pair, key, value, n=scan.rows) for key, value in scan.options["sequences"]]
    return union_all(each)
