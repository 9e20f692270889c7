"""Cross-sectional fidelity: compare the rows that share a timestamp, then average over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.functions.labels import align_labels
from chronofid.functions.numeric import clip01
from chronofid.functions.times import coerce_time
from chronofid.operators.contingency import pair_distances
from chronofid.operators.distributions import SYNTH, cell_distances, ecdf_distances, ks_by, medians, tvd_by
from chronofid.operators.moments import pair_correlations
from chronofid.operators.shape import (
    FEATURE,
    VALUE,
    column_pairs,
    unpivot_labels,
    unpivot_numbers,
)
from chronofid.plans.columns import covered_counts, covered_share, seen_categories, seen_cells
from chronofid.plans.metrics import Scan, evaluate, metric
from chronofid.plans.roles import TableRoles

RANGE_EPSILON = 1e-10
MIN_CORR_ROWS = 3
SECTION_STATISTICS = ["mean", "median", "std"]


def _numbers(pair: DataFrame, roles: TableRoles) -> DataFrame:
    long = unpivot_numbers(pair, [SYNTH, roles.time], roles.num_cols)
    return long.where(F.col(roles.time).isNotNull() & F.col(VALUE).isNotNull())


def _labels(pair: DataFrame, roles: TableRoles) -> DataFrame:
    long = unpivot_labels(pair, [SYNTH, roles.time], roles.cat_cols)
    return long.where(F.col(roles.time).isNotNull() & F.col(VALUE).isNotNull())


def _over_time(per_time: DataFrame, score) -> DataFrame:
    return per_time.groupBy(FEATURE).agg(F.avg(score).alias("score"))


def _shared(per_time: DataFrame) -> DataFrame:
    return per_time.where((F.col("n_real") > 0) & (F.col("n_synth") > 0))


def ks_complement(pair: DataFrame, roles: TableRoles) -> DataFrame:
    rows = pair.count() * len(roles.num_cols)
    per_time = ks_by(_numbers(pair, roles), [FEATURE, roles.time], VALUE, rows)
    return _over_time(_shared(per_time), 1 - F.col("ks"))


def tv_complement(pair: DataFrame, roles: TableRoles) -> DataFrame:
    per_time = tvd_by(_labels(pair, roles), [FEATURE, roles.time], [VALUE])
    return _over_time(_shared(per_time), 1 - F.col("tvd"))


def statistic_similarity(pair: DataFrame, roles: TableRoles, n: int | None = None) -> DataFrame:
    """Mean, median and deviation per timestamp, differences scaled by the real statistic's range."""
    rows = (pair.count() if n is None else n) * len(roles.num_cols)
    long = _numbers(pair, roles)
    group = [FEATURE, roles.time, SYNTH]
    stats = long.groupBy(*group).agg(F.avg(VALUE).alias("mean"), F.stddev_pop(VALUE).alias("std"))
    stats = stats.join(medians(long, group, {"median": VALUE}, rows), group)
    tall = stats.unpivot(group, SECTION_STATISTICS, "statistic", VALUE)
    sides = tall.groupBy(FEATURE, "statistic", roles.time).agg(
        F.max(F.when(~F.col(SYNTH), F.col(VALUE))).alias("real"),
        F.max(F.when(F.col(SYNTH), F.col(VALUE))).alias("synth"),
    )
    spread = sides.groupBy(FEATURE, "statistic").agg((F.max("real") - F.min("real")).alias("spread"))
    off = F.abs(F.col("real") - F.col("synth")) / (F.col("spread") + RANGE_EPSILON)
    both = sides.where(F.col("real").isNotNull() & F.col("synth").isNotNull()).join(spread, [FEATURE, "statistic"])
    per_statistic = both.groupBy(FEATURE, "statistic").agg(F.avg(clip01(1 - off)).alias("score"))
    return per_statistic.groupBy(FEATURE).agg(F.avg("score").alias("score"))


def correlation_similarity(pair: DataFrame, roles: TableRoles) -> DataFrame:
    timed = pair.where(F.col(roles.time).isNotNull())
    rho = pair_correlations(timed, [roles.time], column_pairs(roles.num_cols)).where(
        (F.col("real_n") >= MIN_CORR_ROWS)
        & (F.col("synth_n") >= MIN_CORR_ROWS)
        & F.col("real_rho").isNotNull()
        & F.col("synth_rho").isNotNull()
    )
    return _over_time(rho, 1 - F.abs(F.col("real_rho") - F.col("synth_rho")) / 2)


def range_coverage(pair: DataFrame, roles: TableRoles) -> DataFrame:
    return _over_time(covered_share(_numbers(pair, roles), [FEATURE, roles.time]), F.col("score"))


def category_coverage(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """Every timestamp with real categories counts; one without synthetic rows scores 0."""
    per_time = seen_categories(_labels(pair, roles), [FEATURE, roles.time]).where(F.col("real") > 0)
    return _over_time(per_time, F.col("shared") / F.col("real"))


def contingency_similarity(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """Unlike the static score this one leaves rows with a null category out."""
    timed = pair.where(F.col(roles.time).isNotNull())
    per_time = pair_distances(timed, [roles.time], column_pairs(roles.cat_cols), nulls=False)
    return _over_time(_shared(per_time), 1 - F.col("tvd"))


def supported_numbers(pair: DataFrame, roles: TableRoles) -> list[str]:
    """Numeric columns that have values on both sides within the shared timestamps."""
    shared = shared_times(pair, roles.time)
    long = unpivot_numbers(pair, [SYNTH, roles.time], roles.num_cols).where(F.col(VALUE).isNotNull())
    counts = (
        long.join(shared, roles.time, "left_semi")
        .groupBy(FEATURE)
        .agg(F.count_if(~F.col(SYNTH)).alias("r"), F.count_if(F.col(SYNTH)).alias("s"))
        .collect()
    )
    if not counts and shared.isEmpty():
        return list(roles.num_cols)
    found = {row[FEATURE] for row in counts if row["r"] > 0 and row["s"] > 0}
    return [c for c in roles.num_cols if c in found]


def shared_times(pair: DataFrame, time: str) -> DataFrame:
    """Timestamps that occur on both sides."""
    sides = pair.where(F.col(time).isNotNull()).groupBy(time).agg(
        F.bool_or(SYNTH).alias("s"), F.bool_or(~F.col(SYNTH)).alias("r")
    )
    return sides.where("r and s").select(time)


def prepare(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """Coerce the time column and align category labels to the real side."""
    return align_labels(coerce_time(pair, roles.time), roles.cat_cols)


def suite(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """All cross-sectional scores, one row per metric and feature."""
    return evaluate(Scan(pair, roles), ["sections"]).drop("family")


# ---- registered scores -----------------------------------------------------------------------------


def _number_counts(scan: Scan) -> DataFrame:
    return scan.number_counts([scan.roles.time])


def _label_counts(scan: Scan) -> DataFrame:
    """Categories as they stand; ``options["align"]`` gives both sides the labels that the real side calls for."""
    if scan.options.get("align"):
        return scan.label_counts([scan.roles.time], lambda df: align_labels(df, scan.roles.cat_cols), "aligned")
    return scan.label_counts([scan.roles.time])


def _has_nums(scan: Scan) -> bool:
    return bool(scan.roles.num_cols)


def _has_cats(scan: Scan) -> bool:
    return bool(scan.roles.cat_cols)


@metric("sections", "CS-KSComplement", _has_nums)
def _ks(scan: Scan) -> DataFrame:
    ks = ecdf_distances(_number_counts(scan), [FEATURE, scan.roles.time], VALUE, scan.distinct_numbers([scan.roles.time]), kept=True)
    return _over_time(_shared(ks), 1 - F.col("ks"))


@metric("sections", "CS-StatisticSimilarity", _has_nums)
def _statistics(scan: Scan) -> DataFrame:
    return statistic_similarity(scan.pair, scan.roles, scan.rows)


@metric("sections", "CS-RangeCoverage", _has_nums)
def _range(scan: Scan) -> DataFrame:
    return _over_time(covered_counts(_number_counts(scan), [FEATURE, scan.roles.time]), F.col("score"))


@metric("sections", "CS-TVComplement", _has_cats)
def _tv(scan: Scan) -> DataFrame:
    return _over_time(_shared(cell_distances(_label_counts(scan), [FEATURE, scan.roles.time])), 1 - F.col("tvd"))


@metric("sections", "CS-CategoryCoverage", _has_cats)
def _coverage(scan: Scan) -> DataFrame:
    per_time = seen_cells(_label_counts(scan), [FEATURE, scan.roles.time]).where(F.col("real") > 0)
    return _over_time(per_time, F.col("shared") / F.col("real"))


@metric("sections", "CS-CorrelationSim", lambda scan: len(scan.roles.num_cols) > 1)
def _correlation(scan: Scan) -> DataFrame:
    return correlation_similarity(scan.pair, scan.roles)


@metric("sections", "CS-ContingencySim", lambda scan: len(scan.roles.cat_cols) > 1)
def _contingency(scan: Scan) -> DataFrame:
    pair = align_labels(scan.pair, scan.roles.cat_cols) if scan.options.get("align") else scan.pair
    return contingency_similarity(pair, scan.roles)
