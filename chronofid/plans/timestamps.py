"""Timestamp fidelity: order, uniqueness, duration, range, regularity and interval scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH, ks_by, medians
from chronofid.operators.grid import overlap
from chronofid.operators.ordered import ordered
from chronofid.plans.metrics import Scan, evaluate, metric
from chronofid.plans.roles import TableRoles, numeric_time

REGULAR_CV = 0.01
INTERVAL_TOLERANCE = 0.01


def complement(ks: DataFrame, empty: float | None) -> DataFrame:
    """``1 - ks``, or ``empty`` where one side has no value."""
    score = F.when((F.col("n_real") > 0) & (F.col("n_synth") > 0), 1 - F.col("ks")).otherwise(F.lit(empty))
    return ks.withColumn("score", score)


def share_without(df: DataFrame, violation: Column, empty: float) -> DataFrame:
    """One minus the share of rows with a violation, ``empty`` if there are no rows."""
    bad = F.avg(violation.cast("double"))
    return df.agg(F.coalesce(1 - bad, F.lit(empty)).alias("score"))


def intervals(pair: DataFrame, roles: TableRoles, file_order: bool = False, rows: int | None = None) -> DataFrame:
    """Difference between consecutive rows of a trajectory, in time order or in file order."""
    keyed = numeric_time(pair, roles).where(F.col(roles.key).isNotNull())
    slim = keyed.select(SYNTH, roles.key, roles.time, roles.row)
    order = [roles.row] if file_order else [roles.time, roles.row]
    steps = ordered(slim, [SYNTH, roles.key], order, rows).lag(_before=roles.time).result()
    step = F.col(roles.time) - F.col("_before")
    return steps.select(SYNTH, roles.key, roles.time, roles.row, step.alias("interval")).where(
        F.col("interval").isNotNull()
    )


def order_consistency(pair: DataFrame, roles: TableRoles, n: int | None = None) -> DataFrame:
    synth = pair.where(SYNTH)
    return share_without(intervals(synth, roles, file_order=True, rows=n), F.col("interval") < 0, 1.0)


def _synthetic_steps(pair: DataFrame, roles: TableRoles, steps: DataFrame | None) -> DataFrame:
    """Intervals of the synthetic side; a suite hands in those of both sides to sort the table once."""
    return intervals(pair.where(SYNTH), roles) if steps is None else steps.where(SYNTH)


def uniqueness(pair: DataFrame, roles: TableRoles, steps: DataFrame | None = None) -> DataFrame:
    return share_without(_synthetic_steps(pair, roles, steps), F.col("interval") == 0, 1.0)


def durations(pair: DataFrame, roles: TableRoles) -> DataFrame:
    keyed = numeric_time(pair, roles).where(F.col(roles.key).isNotNull())
    length = F.max(roles.time) - F.min(roles.time)
    return keyed.groupBy(SYNTH, roles.key).agg(length.alias("duration"))


def duration_similarity(pair: DataFrame, roles: TableRoles, n: int | None = None) -> DataFrame:
    return complement(ks_by(durations(pair, roles), [], "duration", pair.count() if n is None else n), 0.0)


def range_compliance(pair: DataFrame, roles: TableRoles, representation: str) -> DataFrame:
    """Share of synthetic rows inside the real time range; relative time must also start at zero."""
    timed = numeric_time(pair, roles)
    t = F.col(roles.time)
    synth = timed.where(SYNTH)
    if representation == "Relative":
        real = durations(pair.where(~F.col(SYNTH)), roles)
        bounds = real.agg(F.lit(0.0).alias("low"), F.max("duration").alias("high"))
        first = (
            synth.where(F.col(roles.key).isNotNull())
            .groupBy(roles.key)
            .agg(F.min_by(t, F.struct(t.isNull(), t, roles.row)).alias("start"))
        )
        # Only a trajectory's first row can be off origin; one that is out of range is counted below.
        inside = (F.col("start") >= 0) & (F.col("start") <= F.col("high"))
        extra = F.sum((F.coalesce(inside, F.lit(False)) & (F.abs("start") > 1e-8)).cast("long"))
        starts = first.join(F.broadcast(bounds), F.lit(True), "left").agg(extra.alias("extra"))
    else:
        bounds = timed.where(~F.col(SYNTH)).agg(F.min(t).alias("low"), F.max(t).alias("high"))
        starts = None
    outside = t.isNull() | (t < F.col("low")) | (t > F.col("high"))
    counted = synth.join(F.broadcast(bounds), F.lit(True), "left").agg(
        F.count(F.lit(1)).alias("n"), F.sum(outside.cast("long")).alias("bad"), F.max("high").alias("high")
    )
    if starts is not None:
        counted = counted.join(F.broadcast(starts), F.lit(True), "left").withColumn(
            "bad", F.col("bad") + F.coalesce("extra", F.lit(0))
        )
    score = (
        F.when(F.col("n") == 0, 1.0)
        .when(F.col("high").isNull(), 0.0)
        .otherwise(1 - F.try_divide("bad", "n"))
    )
    return counted.select(score.alias("score"))


def regularity(pair: DataFrame, roles: TableRoles, interval: float, steps: DataFrame | None = None) -> DataFrame:
    """Share of synthetic intervals within 1 % of the representative interval."""
    off = F.abs(F.col("interval") - interval) > interval * INTERVAL_TOLERANCE
    return share_without(_synthetic_steps(pair, roles, steps), off, 0.0)


def grid_completeness(pair: DataFrame, roles: TableRoles, interval: float, n: int | None = None) -> DataFrame:
    """Overlap of grid occupancy, with its support and multiplicity parts.

    A real trajectory occupies as many grid cells in a row as it has distinct positions; a synthetic
    one occupies the cells its times round to.
    """
    timed = numeric_time(pair, roles).where(F.col(roles.key).isNotNull() & F.col(roles.time).isNotNull())
    cell = F.rint(F.col(roles.time) / interval).cast("long")
    seen = timed.select(SYNTH, roles.key, cell.alias("cell")).distinct()
    runs = seen.where(~F.col(SYNTH)).groupBy(roles.key).agg(F.min("cell").alias("lo"), F.count("cell").alias("n"))
    parts = overlap(runs, seen.where(SYNTH), 3 * (pair.count() if n is None else n))
    return parts.select(
        F.try_divide("covered", "total").alias("score"),
        F.try_divide("shared", "support").alias("support_coverage"),
        F.try_divide("covered", "shared_mass").alias("multiplicity_preservation"),
    )


def interval_similarity(pair: DataFrame, roles: TableRoles, steps: DataFrame | None = None, n: int | None = None) -> DataFrame:
    n = pair.count() if n is None else n
    steps = intervals(pair, roles, rows=n) if steps is None else steps
    return complement(ks_by(steps, [], "interval", n), 0.0)


def periodicity(pair: DataFrame, roles: TableRoles, n: int | None = None) -> DataFrame:
    """One row: Regular or Irregular, and the representative interval of a regular table."""
    real = pair.where(~F.col(SYNTH))
    n = real.count() if n is None else n
    steps = intervals(real, roles, rows=n)
    middle = medians(steps, [], {"median": "interval"}, n)
    stats = steps.agg(F.avg("interval").alias("mean"), F.stddev_pop("interval").alias("std"))
    joined = stats.join(F.broadcast(middle), F.lit(True), "left")
    if roles.periodicity is not None:
        regular = F.lit(roles.periodicity.title() == "Regular")
        usable = regular & (F.col("median") > 0)
    else:
        regular = F.coalesce((F.col("mean") != 0) & (F.try_divide("std", "mean") < REGULAR_CV), F.lit(False))
        usable = regular
    return joined.select(
        F.when(regular, "Regular").otherwise("Irregular").alias("periodicity"),
        F.when(usable, F.col("median")).alias("interval"),
    )


def representation(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """One row: Relative if all real trajectories start at the same time, else Absolute."""
    if roles.representation is not None:
        return pair.sparkSession.range(1).select(F.lit(roles.representation.title()).alias("representation"))
    real = numeric_time(pair, roles).where(~F.col(SYNTH) & F.col(roles.key).isNotNull())
    starts = real.groupBy(roles.key).agg(F.min(roles.time).alias("start"))
    same = F.coalesce(F.min("start") == F.max("start"), F.lit(False))
    return starts.agg(F.when(same, "Relative").otherwise("Absolute").alias("representation"))


def characteristics(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """Flows and rows per side."""
    flows = pair.where(F.col(roles.key).isNotNull()).select(SYNTH, roles.key).distinct()
    n_flows = flows.groupBy(SYNTH).agg(F.count(F.lit(1)).alias("num_flows"))
    n_rows = pair.groupBy(SYNTH).agg(F.count(F.lit(1)).alias("total_observations"))
    return n_rows.join(n_flows, SYNTH, "left").na.fill(0, ["num_flows"])


def elapsed_time(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """Shift relative time so that each trajectory starts at zero: minimum per key, joined back."""
    starts = pair.groupBy(SYNTH, roles.key).agg(F.min(roles.time).alias("_start"))
    joined = pair.join(starts, [SYNTH, roles.key], "left")
    return joined.withColumn(roles.time, F.col(roles.time) - F.col("_start")).drop("_start")


def suite(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """All timestamp scores of one table; those that do not apply are null."""
    return evaluate(Scan(pair, roles), ["timestamps"]).drop("family")


# ---- registered scores -----------------------------------------------------------------------------


def _steps(scan: Scan) -> DataFrame:
    """Intervals of both sides: equal subplans share one exchange, so the table is shuffled once for all interval scores."""
    return scan.once("steps", lambda: intervals(scan.pair, scan.roles, rows=scan.rows))


def _kind(scan: Scan) -> tuple[str, float | None]:
    row = scan.once("periodicity", lambda: periodicity(scan.pair, scan.roles, scan.rows).first())
    return row["periodicity"], row["interval"]


def _step(scan: Scan) -> float | None:
    """The representative interval of a regular table."""
    kind, interval = _kind(scan)
    return interval if kind == "Regular" else None


def _none(scan: Scan) -> DataFrame:
    return scan.pair.sparkSession.range(1).select(F.lit(None).cast("double").alias("score"))


@metric("timestamps", "TemporalOrderConsistency")
def _order(scan: Scan) -> DataFrame:
    return order_consistency(scan.pair, scan.roles, scan.rows)


@metric("timestamps", "TimestampUniqueness")
def _uniqueness(scan: Scan) -> DataFrame:
    return uniqueness(scan.pair, scan.roles, _steps(scan))


@metric("timestamps", "TrajectoryDurationSimilarity")
def _duration(scan: Scan) -> DataFrame:
    return duration_similarity(scan.pair, scan.roles, scan.rows)


@metric("timestamps", "TemporalRangeCompliance")
def _range(scan: Scan) -> DataFrame:
    form = scan.once("representation", lambda: representation(scan.pair, scan.roles).first()["representation"])
    return range_compliance(scan.pair, scan.roles, form)


@metric("timestamps", "RegularityConsistency")
def _regularity(scan: Scan) -> DataFrame:
    step = _step(scan)
    return _none(scan) if step is None else regularity(scan.pair, scan.roles, step, _steps(scan))


@metric("timestamps", "GridCompleteness")
def _grid(scan: Scan) -> DataFrame:
    step = _step(scan)
    return _none(scan) if step is None else grid_completeness(scan.pair, scan.roles, step, scan.rows)


@metric("timestamps", "TimeIntervalDistributionSim")
def _intervals(scan: Scan) -> DataFrame:
    return interval_similarity(scan.pair, scan.roles, _steps(scan), scan.rows) if _kind(scan)[0] == "Irregular" else _none(scan)
