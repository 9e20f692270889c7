"""Spectral embedding of trajectories: one vector of Fourier magnitudes per entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.operators.shape import unpivot_numbers
from chronofid.operators.spectra import channel_moments, dft, differences, scale_channels
from chronofid.plans.roles import TableRoles

FREQUENCIES = 8
EPSILON = 1e-8


def joint_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and deviation per channel over all rows given, for embeddings on one scale."""
    long = unpivot_numbers(df, [], cols).withColumnsRenamed({"feature": "channel"})
    return channel_moments(long, ["channel"], "value")


def trajectory_states(df: DataFrame, roles: TableRoles) -> DataFrame:
    """Per key: its length and whether a channel value is missing or not finite."""
    broken = F.lit(False)
    for c in roles.num_cols:
        x = F.col(c).cast("double")
        broken = broken | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    keyed = df.where(F.col(roles.key).isNotNull())
    return keyed.groupBy(roles.key).agg(F.count(F.lit(1)).alias("length"), F.bool_or(broken).alias("broken"))


def report(df: DataFrame, roles: TableRoles, pad_short: bool = False) -> DataFrame:
    """One row: trajectories in all, kept, and skipped or padded by reason."""
    short = F.col("length") < 2
    states = trajectory_states(df, roles).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(short).alias("n_short"),
        F.count_if(~short & F.col("broken")).alias("n_skipped_nan"),
    )
    padded = F.col("n_short") if pad_short else F.lit(0).cast("long")
    return states.select(
        "n_total", (F.col("n_short") - padded).alias("n_skipped_short"), padded.alias("n_padded_short"), "n_skipped_nan",
        (F.col("n_total") - F.col("n_short") + padded - F.col("n_skipped_nan")).alias("n_kept"),
    )


def magnitudes(
    df: DataFrame,
    roles: TableRoles,
    frequencies: int = FREQUENCIES,
    epsilon: float = EPSILON,
    on_nan: str = "raise",
    moments: DataFrame | None = None,
    pad_short: bool = False,
) -> DataFrame:
    """Long embedding ``(key, channel, freq, dim, mag)``, dimensions in channel order.

    Values are scaled per trajectory, or by given channel ``moments``, differenced, and transformed at
    the length of the differences or ``frequencies``, whichever is larger. Trajectories of one row are
    left out or, padded, all zero.
    """
    if on_nan not in ("raise", "skip"):
        raise ValueError(f"on_nan must be 'raise' or 'skip', not {on_nan!r}")
    if frequencies < 1:
        raise ValueError("frequencies must be at least 1")
    if not roles.num_cols:
        raise ValueError("at least one numeric channel is required")
    key, cols = roles.key, roles.num_cols
    states = trajectory_states(df, roles)
    usable = states.where((F.col("length") >= 2) & ~F.col("broken"))
    if on_nan == "raise":
        bad = [r[0] for r in states.where((F.col("length") >= 2) & F.col("broken")).select(key).limit(5).collect()]
        if bad:
            raise ValueError(f"missing or infinite values in trajectories {bad}; impute them or skip")
    rows = df.join(usable.select(key, "length"), key, "inner")
    long = unpivot_numbers(rows, [key, roles.time, roles.row, "length"], cols).withColumnsRenamed({"feature": "channel"})
    series = [key, "channel"]
    if moments is None:
        scaled = scale_channels(long, series, "value", channel_moments(long, series, "value"), epsilon)
    else:
        scaled = scale_channels(long, ["channel"], "value", moments, epsilon)
    steps = differences(scaled, series, [roles.time, roles.row], "value")
    steps = steps.withColumn("_n", F.greatest(F.col("length") - 1, F.lit(frequencies)).cast("long"))
    freqs = F.sequence(F.lit(0).cast("long"), F.lit(frequencies - 1).cast("long"))
    mags = dft(steps, series, "ix", "value", "_n", freqs)
    if pad_short:
        alone = states.where(F.col("length") < 2).select(key, F.explode(F.array(*map(F.lit, cols))).alias("channel"))
        zeros = alone.select(*series, F.explode(freqs).alias("freq"), F.lit(0.0).alias("mag"))
        mags = mags.unionByName(zeros)
    place = F.coalesce(*[F.when(F.col("channel") == c, i) for i, c in enumerate(cols)])
    return mags.select(*series, "freq", (place * frequencies + F.col("freq")).cast("long").alias("dim"), "mag")


def vectors(mags: DataFrame, keys: list[str]) -> DataFrame:
    """One array per entity; its size is channels times frequencies."""
    parts = F.array_sort(F.collect_list(F.struct("dim", "mag")))
    return mags.groupBy(*keys).agg(F.transform(parts, lambda p: p["mag"]).alias("vec"))
