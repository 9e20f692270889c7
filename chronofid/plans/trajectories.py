"""Longitudinal fidelity: how values move inside an entity's trajectory."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH, ecdf_distances, medians, value_counts
from chronofid.operators.lagged import lagged_means
from chronofid.operators.ordered import ordered, same_keys
from chronofid.operators.shape import FEATURE, VALUE, unpivot_labels, unpivot_numbers
from chronofid.operators.spectra import (
    channel_moments,
    differences,
    half_spectrum,
    projected,
    ray_parts,
    scale_channels,
    sliced_wasserstein,
    sliced_wasserstein_by_ray,
    unfolded_rays,
)
from chronofid.plans import panel
from chronofid.plans.metrics import Scan, evaluate, metric
from chronofid.plans.roles import TableRoles
from chronofid.session import checkpointed, segment_rows

PROJECTIONS = 50
MIN_NORM = 1e-12


def first_differences(pair: DataFrame, roles: TableRoles, n: int | None = None, kept: bool = False) -> DataFrame:
    """Consecutive differences per trajectory and feature, nulls dropped beforehand; ``kept`` says that ``pair`` is read from files."""
    ids = [SYNTH, roles.key, roles.time, roles.row]
    long = unpivot_numbers(pair.where(F.col(roles.key).isNotNull()), ids, roles.num_cols)
    rows = (pair.count() if n is None else n) * len(roles.num_cols)
    known = long.where(F.col(VALUE).isNotNull())
    return differences(known, [FEATURE, SYNTH, roles.key], [roles.time, roles.row], VALUE, rows, kept)


def first_difference_ks(pair: DataFrame, roles: TableRoles, n: int | None = None, kept: bool = False) -> DataFrame:
    n = pair.count() if n is None else n
    rows = n * len(roles.num_cols)
    counts = value_counts(first_differences(pair, roles, n, kept), [FEATURE], VALUE)
    written = rows > segment_rows(pair.sparkSession)
    if written:
        # Distances and spans both read them.
        counts = checkpointed(counts)
        rows = counts.count()
    spans = []
    for side in ("real", "synth"):
        x = F.when(F.col(f"{side}_n") > 0, F.col(VALUE))
        spans += [F.min(x).alias(f"{side}_lo"), F.max(x).alias(f"{side}_hi")]
    ks = ecdf_distances(counts, [FEATURE], VALUE, rows, written).join(counts.groupBy(FEATURE).agg(*spans), FEATURE)
    constant = (F.col("real_lo") == F.col("real_hi")) & (F.col("synth_lo") == F.col("synth_hi"))
    close = F.abs(F.col("real_lo") - F.col("synth_lo")) <= 1e-8 + 1e-5 * F.abs("synth_lo")
    enough = (F.col("n_real") >= 2) & (F.col("n_synth") >= 2)
    score = F.when(enough, F.when(constant & close, 1.0).otherwise(1 - F.col("ks")))
    return ks.select(FEATURE, score.alias("score"))


def next_steps(pair: DataFrame, roles: TableRoles, n: int | None = None, kept: bool = False) -> DataFrame:
    """Each row with the category and time that follow it in its trajectory."""
    ids = [SYNTH, roles.key, roles.time, roles.row]
    long = unpivot_labels(pair.where(F.col(roles.key).isNotNull()), ids, roles.cat_cols)
    timed = long.where(F.col(roles.time).isNotNull())
    rows = (pair.count() if n is None else n) * len(roles.cat_cols)
    return ordered(timed, [FEATURE, SYNTH, roles.key], [roles.time, roles.row], rows, kept).lead(
        next_value=VALUE, next_time=roles.time
    ).result()


def transition_shares(pair: DataFrame, roles: TableRoles, n: int | None = None, kept: bool = False) -> DataFrame:
    """Transitions between neighbouring real times with ``P(to | time, from)`` of each side."""
    times = pair.where(~F.col(SYNTH) & F.col(roles.time).isNotNull()).select(roles.time).distinct()
    n = pair.count() if n is None else n
    expected = ordered(times, [], [roles.time], n).lead(expected=roles.time).result()
    moves = next_steps(pair, roles, n, kept).where(F.col(VALUE).isNotNull() & F.col("next_value").isNotNull())
    adjacent = moves.join(expected, roles.time, "inner").where(F.col("next_time") == F.col("expected"))
    group = [FEATURE, roles.time, VALUE]
    cells = adjacent.groupBy(*group, "next_value").agg(
        F.count_if(~F.col(SYNTH)).alias("r"), F.count_if(F.col(SYNTH)).alias("s")
    )
    # Counted cells are few: one per time and category pair. A group holds at most one per category.
    whole = Window.partitionBy(*group)
    return checkpointed(cells).withColumns(
        {
            "real_share": F.coalesce(F.try_divide(F.col("r"), F.sum("r").over(whole)), F.lit(0.0)),
            "synth_share": F.coalesce(F.try_divide(F.col("s"), F.sum("s").over(whole)), F.lit(0.0)),
        }
    )


def transition_similarity(pair: DataFrame, roles: TableRoles, n: int | None = None, kept: bool = False) -> DataFrame:
    """Mean over shared times of one minus the transition-table distance."""
    shares = transition_shares(pair, roles, n, kept)
    cats = (
        shares.select(FEATURE, F.explode(F.array(VALUE, "next_value")).alias("c"))
        .distinct()
        .groupBy(FEATURE)
        .agg(F.count(F.lit(1)).alias("n_cats"))
    )
    per_time = shares.groupBy(FEATURE, roles.time).agg(
        F.sum(F.abs(F.col("real_share") - F.col("synth_share"))).alias("gap"), F.sum("r").alias("r"), F.sum("s").alias("s")
    )
    shared = per_time.where("r > 0 and s > 0").join(cats, FEATURE)
    return shared.groupBy(FEATURE).agg(F.avg(1 - F.col("gap") / (2 * F.col("n_cats"))).alias("score"))


def autocorrelation(
    series: DataFrame, keys: list[str], order: list[str], value: str, max_lag: int, rows: int | None = None, kept: bool = False
) -> DataFrame:
    """Autocorrelation for lags 1 to ``max_lag`` of every series that is long enough.

    A series longer than one segment is cut into pieces by position. The first rows of a piece are also
    given to the piece before it, so that each pair of rows meets exactly once. Products are summed inside a piece.
    """
    known = series.where(F.col(value).isNotNull())
    rows = known.count() if rows is None else rows
    placed = ordered(known, keys, order, rows, kept).numbered("pos").result()
    stats = known.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")
    ).where(F.col("n") > max_lag)
    joined = placed.alias("l").join(stats.alias("r"), same_keys("l", "r", keys), "inner")
    joined = joined.select("l.*", "r.mean")
    size = max(segment_rows(series.sparkSession), max_lag)
    piece = F.floor(F.col("pos") / size)
    look_ahead = (piece > 0) & (F.col("pos") % size < max_lag)
    pieces = F.when(look_ahead, F.array(piece, piece - 1)).otherwise(F.array(piece))
    cut = joined.withColumn("home", piece).withColumn("piece", F.explode(pieces))
    cut = cut.withColumns({"_x": (F.col(value) - F.col("mean")).cast("double"), "_home": F.col("home") == F.col("piece")})
    means = lagged_means(cut, keys, max_lag)
    out = means.alias("l").join(stats.alias("r"), same_keys("l", "r", keys), "inner").select("l.*", "r.var")
    return out.select(*keys, "lag", F.when(F.col("var") == 0, 0.0).otherwise(F.try_divide("product", "var")).alias("acf"))


def default_max_lag(pair: DataFrame, roles: TableRoles, n: int | None = None) -> DataFrame:
    """One row: an eighth of the median real trajectory length, at least one."""
    real = pair.where(~F.col(SYNTH) & F.col(roles.key).isNotNull())
    lengths = real.groupBy(roles.key).agg(F.count(F.lit(1)).alias("n"))
    middle = medians(lengths, [], {"m": "n"}, pair.count() if n is None else n)
    eighth = F.floor(F.floor("m") / 8)
    return middle.select(F.when(F.col("m").isNull(), 0).otherwise(F.greatest(F.lit(1), eighth)).cast("long").alias("max_lag"))


def acf_by_side(pair: DataFrame, roles: TableRoles, max_lag: int, n: int | None = None, kept: bool = False) -> DataFrame:
    """Per feature, side and lag: mean over trajectories, or of the mean series over time."""
    long = unpivot_numbers(pair, [SYNTH, roles.key, roles.time, roles.row], roles.num_cols)
    rows = (pair.count() if n is None else n) * len(roles.num_cols)
    if roles.independence == "independent":
        keyed = long.where(F.col(roles.key).isNotNull())
        acf = autocorrelation(keyed, [FEATURE, SYNTH, roles.key], [roles.time, roles.row], VALUE, max_lag, rows, kept)
        return acf.groupBy(FEATURE, SYNTH, "lag").agg(F.avg("acf").alias("acf"))
    macro = long.where(F.col(roles.time).isNotNull()).groupBy(FEATURE, SYNTH, roles.time).agg(F.avg(VALUE).alias(VALUE))
    return autocorrelation(macro, [FEATURE, SYNTH], [roles.time], VALUE, max_lag, rows)


def autocorrelation_similarity(
    pair: DataFrame, roles: TableRoles, max_lag: int, n: int | None = None, kept: bool = False
) -> DataFrame:
    """One minus half the mean absolute difference of the autocorrelations; null if not computable."""
    sides = acf_by_side(pair, roles, max_lag, n, kept).groupBy(FEATURE, "lag").agg(
        F.max(F.when(~F.col(SYNTH), F.col("acf"))).alias("r"), F.max(F.when(F.col(SYNTH), F.col("acf"))).alias("s")
    )
    return sides.groupBy(FEATURE).agg((1 - F.avg(F.abs(F.col("r") - F.col("s"))) / 2).alias("score"))


def autocorrelation_diagnostics(pair: DataFrame, roles: TableRoles, max_lag: int) -> DataFrame:
    """Per feature and side: trajectories, those long enough, median and maximum length."""
    long = unpivot_numbers(pair, [SYNTH, roles.key, roles.time], roles.num_cols).where(F.col(VALUE).isNotNull())
    if roles.independence != "independent":
        timed = long.where(F.col(roles.time).isNotNull()).select(FEATURE, SYNTH, roles.time).distinct()
        points = timed.groupBy(FEATURE, SYNTH).agg(F.count(F.lit(1)).alias("time_points"))
        return points.withColumn("can_compute", F.col("time_points") > max_lag)
    lengths = long.where(F.col(roles.key).isNotNull()).groupBy(FEATURE, SYNTH, roles.key).agg(F.count(F.lit(1)).alias("n"))
    group = [FEATURE, SYNTH]
    stats = lengths.groupBy(*group).agg(
        F.count(F.lit(1)).alias("flows"),
        F.count_if(F.col("n") > max_lag).alias("valid_flows"),
        F.max("n").alias("max_length"),
    )
    middle = medians(lengths, group, {"median_length": "n"}, pair.count() * len(roles.num_cols))
    return stats.join(middle, group).withColumn("can_compute", F.col("valid_flows") > 0)


def spectrum(
    pair: DataFrame,
    roles: TableRoles,
    fill_method: str = "edge_nearest",
    reference: str = "real",
    apply_diff: bool = True,
    feature_type: str = "magnitude",
    reduce: str = "none",
    normalize: bool = True,
) -> DataFrame:
    """Spectral features per entity: ``(is_synth, key, channel, freq, dim, mag)``.

    Panel, z-score per channel, first difference, half spectrum, optional reduction over channels, and
    scaling of each entity's features to sum to one.
    """
    if feature_type not in ("magnitude", "power"):
        raise ValueError("feature_type must be 'magnitude' or 'power'")
    if reduce not in ("none", "mean", "sum", "median"):
        raise ValueError(f"channels can be kept (none) or reduced by mean, sum or median, not by {reduce!r}")
    index = panel.time_index(pair, roles.time)
    width = index.count()
    # The panel feeds both the channel moments and the transform: written once, read twice.
    grid = checkpointed(panel.align(pair, roles, fill_method, index=index, width=width))
    length = width - 1 if apply_diff else width
    if length < 2:
        raise ValueError("need at least two values per trajectory after differencing")
    long = panel.channels(grid, roles)
    if reference in ("real", "pooled"):
        fit = long if reference == "pooled" else long.where(~F.col(SYNTH))
        long = scale_channels(long, ["channel"], VALUE, channel_moments(fit, ["channel"], VALUE), None)
    elif reference != "none":
        raise ValueError("reference must be one of real, pooled, none")
    entity = [SYNTH, roles.key]
    series = [*entity, "channel"]
    if apply_diff:
        long = differences(long, series, ["time_ix"], VALUE, width)
    else:
        long = long.withColumn("ix", F.col("time_ix"))
    bins = length // 2 + 1
    spec = half_spectrum(long, series, "ix", VALUE, length)
    if feature_type == "power":
        spec = spec.withColumn("mag", F.col("mag") * F.col("mag"))
    if reduce != "none":
        # A group holds one value per channel, so the buffer of ``median`` is as small as the channel list.
        merge = {"mean": F.avg, "sum": F.sum, "median": F.median}[reduce]
        spec = spec.groupBy(*entity, "freq").agg(merge("mag").alias("mag")).withColumn("channel", F.lit("*"))
    if normalize:
        # An entity has as many rows as channels times bins, whatever the size of the table.
        total = F.sum("mag").over(Window.partitionBy(*entity))
        spec = spec.withColumn("mag", F.col("mag") / F.greatest(total, F.lit(MIN_NORM)))
    place = {c: i for i, c in enumerate(roles.num_cols)}
    offset = F.coalesce(*[F.when(F.col("channel") == c, i) for c, i in place.items()], F.lit(0)) * bins
    return spec.select(*entity, "channel", "freq", (offset + F.col("freq")).cast("long").alias("dim"), "mag")


def sliced_tt_wasserstein(
    pair: DataFrame, roles: TableRoles, fill_method: str = "edge_nearest", projections: int = PROJECTIONS
) -> DataFrame:
    """Sliced Wasserstein-1 distance of the spectra, jointly (feature ``*``) and per channel with its rank."""
    features = spectrum(pair, roles, fill_method)
    entity = [SYNTH, roles.key]
    # Channels are parts of the joint vector: their sums make up its sums.
    parts = ray_parts(features, [*entity, "channel"], "dim", "mag", projections)
    entities = pair.where(F.col(roles.key).isNotNull()).select(*entity).distinct().count()
    if entities <= segment_rows(pair.sparkSession):
        distances = sliced_wasserstein_by_ray(parts, entity, "channel")
    else:
        sums = unfolded_rays(parts, [*entity, "channel"])
        both = sums.withColumn(FEATURE, F.explode(F.array(F.lit("*"), F.col("channel")))).drop("channel")
        rows = entities * (len(roles.num_cols) + 1) * projections
        distances = sliced_wasserstein(projected(both, [*entity, FEATURE]), [FEATURE], rows)
    # One row per channel and one joint row: these windows see as many rows as there are columns.
    single = F.col(FEATURE) != "*"
    w = Window.partitionBy(single)
    share = F.coalesce(F.try_divide(F.col("distance"), F.sum("distance").over(w)), F.lit(0.0))
    place = F.row_number().over(w.orderBy(F.desc("distance"), FEATURE)).cast("long")
    return distances.select(
        FEATURE, "distance", F.when(single, share).alias("contribution"), F.when(single, place).alias("rank")
    )


def suite(pair: DataFrame, roles: TableRoles, max_lag: int | None = None, fill_method: str = "edge_nearest") -> DataFrame:
    """All longitudinal scores of one table, one row per metric and feature."""
    scan = Scan(pair, roles, {"max_lag": max_lag, "fill_method": fill_method})
    return evaluate(scan, ["trajectories"]).drop("family")


# ---- registered scores -----------------------------------------------------------------------------


def _has_nums(scan: Scan) -> bool:
    return bool(scan.roles.num_cols)


def _max_lag(scan: Scan) -> int:
    given = scan.options.get("max_lag")
    return scan.once("max_lag", lambda: default_max_lag(scan.pair, scan.roles, scan.rows).first()["max_lag"]) if given is None else given


@metric("trajectories", "FirstDifferenceKSComplement", _has_nums)
def _first_difference(scan: Scan) -> DataFrame:
    return first_difference_ks(scan.pair, scan.roles, scan.rows, kept=True)


@metric("trajectories", "AutoCorrelationSimilarity", _has_nums)
def _autocorrelation(scan: Scan) -> DataFrame:
    return autocorrelation_similarity(scan.pair, scan.roles, _max_lag(scan), scan.rows, kept=True)


@metric("trajectories", "SlicedTTWasserstein", _has_nums, column="distance")
def _wasserstein(scan: Scan) -> DataFrame:
    return sliced_tt_wasserstein(scan.pair, scan.roles, scan.options.get("fill_method", "edge_nearest"))


@metric("trajectories", "TransitionMatrixTVDComplement", lambda scan: bool(scan.roles.cat_cols))
def _transitions(scan: Scan) -> DataFrame:
    return transition_similarity(scan.pair, scan.roles, scan.rows, kept=True)
