"""Structural fidelity: sequence lengths, cardinality over time, correlation across joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.functions.numeric import clip01, to_double
from chronofid.functions.times import floor_time, seconds
from chronofid.operators.correlation import pair_corr
from chronofid.operators.distributions import SYNTH, ecdf_distances, ks_by, medians
from chronofid.operators.joins import Hop, khop_join
from chronofid.operators.ordered import ordered
from chronofid.plans.roles import TableRoles

DAY = 86400
MIN_BIN_ROWS = 5
# A median step of at least this many days calls for windows of as many seconds.
WINDOW_LADDER = [(28, 30 * DAY), (7, 7 * DAY), (1, DAY)]
HOUR = 3600


def sequence_lengths(pair: DataFrame, key: str) -> DataFrame:
    """Rows per key and side; a null key is a key."""
    return pair.groupBy(SYNTH, key).agg(F.count(F.lit(1)).alias("length"))


def length_similarity(pair: DataFrame, roles: TableRoles, strict: bool = False) -> DataFrame:
    """KS complement of the lengths with their statistics; strict mode gives null for fixed lengths."""
    lengths = sequence_lengths(pair, roles.key)
    rows = pair.count()
    ks = ks_by(lengths, [], "length", rows)
    sides = []
    for side, here in (("real", ~F.col(SYNTH)), ("synth", F.col(SYNTH))):
        x = F.when(here, F.col("length"))
        sides += [
            F.avg(x).alias(f"{side}_mean"), F.stddev_pop(x).alias(f"{side}_std"),
            F.min(x).alias(f"{side}_min"), F.max(x).alias(f"{side}_max"),
        ]
    stats = lengths.agg(*sides)
    middles = medians(
        lengths.select(
            F.when(~F.col(SYNTH), F.col("length")).alias("r"), F.when(F.col(SYNTH), F.col("length")).alias("s")
        ),
        [], {"real_median": "r", "synth_median": "s"}, rows,
    )
    fixed = (F.col("real_min") == F.col("real_max")) & (F.col("synth_min") == F.col("synth_max"))
    score = F.when((F.col("n_real") > 0) & (F.col("n_synth") > 0) & ~(fixed & F.lit(strict)), 1 - F.col("ks"))
    joined = ks.join(F.broadcast(stats), F.lit(True), "left").join(F.broadcast(middles), F.lit(True), "left")
    return joined.select(
        score.alias("score"), F.col("n_real").alias("real_flows"), F.col("n_synth").alias("synth_flows"),
        *[c for c in [*stats.columns, *middles.columns]],
    )


def window_width(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """One row: window width in seconds for the median step between distinct real times."""
    real = pair.where(~F.col(SYNTH) & F.col(roles.time).isNotNull())
    times = real.select(seconds(roles.time).alias("t")).distinct()
    rows = pair.count()
    steps = ordered(times, [], ["t"], rows).lag(before="t").result()
    step = medians(steps.select((F.col("t") - F.col("before")).alias("step")), [], {"step": "step"}, rows)
    width = F.when(F.col("step").isNull(), DAY)
    for days, seconds_wide in WINDOW_LADDER:
        width = width.when(F.col("step") >= days * DAY, seconds_wide)
    return step.select(F.col("step").alias("median_step"), width.otherwise(HOUR).cast("long").alias("width"))


def cardinality_similarity(
    pair: DataFrame, roles: TableRoles, width: int, parents: DataFrame | None = None, align_to_real: bool = True
) -> DataFrame:
    """KS complement of child counts per parent and window, zeros included.

    Only non-empty cells exist as rows. The number of empty cells follows from the number of parents
    and windows, so the full parent-by-window table is never built. ``parents`` may list further
    parent ids per side (columns ``is_synth`` and the key).
    """
    times = pair if not align_to_real else pair.where(~F.col(SYNTH))
    t = F.unix_seconds(F.col(roles.time).cast("timestamp"))
    micros = F.unix_micros(F.col(roles.time).cast("timestamp"))
    bounds = times.agg(F.min(t).alias("lo"), F.max(F.ceil(micros / 1e6)).alias("hi")).first()
    ids = pair.select(SYNTH, roles.key).where(F.col(roles.key).isNotNull())
    if parents is not None:
        ids = ids.unionByName(parents.select(SYNTH, roles.key))
    known = {r[SYNTH]: r["n"] for r in ids.distinct().groupBy(SYNTH).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_real, n_synth = known.get(False, 0), known.get(True, 0)
    if bounds["lo"] is None or not n_real or not n_synth:
        return pair.sparkSession.createDataFrame(
            [(None, None, 0, n_real, n_synth)],
            "score double, per_window_mean double, n_windows long, real_parents long, synth_parents long",
        )
    start = bounds["lo"] // width
    windows = max(-(-bounds["hi"] // width) - start, 1)
    cell = (floor_time(roles.time, width) / width).cast("long") - start
    cells = (
        pair.where(F.col(roles.key).isNotNull() & F.col(roles.time).isNotNull())
        .groupBy(SYNTH, roles.key, cell.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("w") >= 0) & (F.col("w") < windows))
    )
    counts = cells.groupBy("w", "n").agg(
        F.count_if(~F.col(SYNTH)).alias("real_n"), F.count_if(F.col(SYNTH)).alias("synth_n")
    )
    filled = counts.groupBy("w").agg(F.sum("real_n").alias("r"), F.sum("synth_n").alias("s"))
    empty = filled.select(
        "w", F.lit(0).cast("long").alias("n"), (n_real - F.col("r")).alias("real_n"), (n_synth - F.col("s")).alias("synth_n")
    )
    per_window_counts = counts.unionByName(empty)
    per_window = ecdf_distances(per_window_counts, ["w"], "n", pair.count() * 2)
    by_window = per_window.agg(F.sum(1 - F.col("ks")).alias("scores"), F.count(F.lit(1)).alias("seen"))
    # Windows without a row on either side hold zeros only and agree fully.
    mean = (F.coalesce("scores", F.lit(0.0)) + windows - F.col("seen")) / windows
    pooled = counts.groupBy("n").agg(F.sum("real_n").alias("real_n"), F.sum("synth_n").alias("synth_n"))
    in_cells = counts.agg(
        F.coalesce(F.sum("real_n"), F.lit(0)).alias("r"), F.coalesce(F.sum("synth_n"), F.lit(0)).alias("s")
    )
    zeros = in_cells.select(
        F.lit(0).cast("long").alias("n"),
        (F.lit(n_real * windows) - F.col("r")).alias("real_n"),
        (F.lit(n_synth * windows) - F.col("s")).alias("synth_n"),
    )
    whole = ecdf_distances(pooled.unionByName(zeros), [], "n", pair.count() + 1)
    return whole.join(F.broadcast(by_window), F.lit(True), "left").select(
        clip01(1 - F.col("ks")).alias("score"),
        mean.alias("per_window_mean"),
        F.lit(windows).cast("long").alias("n_windows"),
        F.lit(n_real).cast("long").alias("real_parents"),
        F.lit(n_synth).cast("long").alias("synth_parents"),
    )


def bin_correlations(joined: DataFrame, a: str, b: str, time: str, synth: str, width: int) -> DataFrame:
    """Correlation per time bin and side, for bins with enough rows that vary on both sides."""
    long = joined.where(F.col(time).isNotNull()).select(
        F.col(synth).alias(SYNTH), floor_time(time, width).alias("bin"), to_double(a).alias("a"), to_double(b).alias("b")
    )
    rho = pair_corr(long, ["bin"])
    enough = (F.col("real_n") >= MIN_BIN_ROWS) & (F.col("synth_n") >= MIN_BIN_ROWS)
    return rho.where(enough & F.col("real_rho").isNotNull() & F.col("synth_rho").isNotNull())


def khop_similarity(
    tables: dict[str, DataFrame],
    path: list[Hop],
    a: tuple[str, str],
    b: tuple[str, str],
    time: tuple[str, str],
    synth: tuple[str, str],
    width: int,
) -> DataFrame:
    """One minus half the mean difference of the per-bin correlations of two columns joined over ``path``."""
    joined = khop_join(tables, a[0], path, [a, b, time, synth])
    names = ["__".join(x) for x in (a, b, time, synth)]
    bins = bin_correlations(joined, *names, width)
    gap = F.abs(F.col("real_rho") - F.col("synth_rho"))
    stats = bins.agg(F.avg(gap).alias("mae"), F.count(F.lit(1)).alias("n_bins"))
    score = F.when(F.col("n_bins") >= 2, clip01(1 - F.col("mae") / 2))
    return stats.select(score.alias("score"), "mae", "n_bins")
