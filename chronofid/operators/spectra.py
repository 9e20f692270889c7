"""Channel scaling, Fourier magnitudes and sliced distances over long frames."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.operators.distributions import SYNTH, ecdf_distances, value_counts
from chronofid.operators.lagged import whole_pieces
from chronofid.operators.ordered import ordered, same_keys

MIN_DEVIATION = 1e-12
# The coefficients and modulus of the integer hash behind the projection directions.
HASH_A, HASH_B, HASH_C, HASH_MOD = 73856093, 19349663, 83492791, 999983
HASH_SECOND = 5003
FFT_LENGTH = 128
#: Products of values and waves that a task holds at a time.
TERMS_HELD = 4 << 20
#: Rows of ray sums gathered before whole vectors are projected.
RAYS_GATHERED = 1 << 14


def channel_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation per key, NaN and infinity left out; unknown gives zero."""
    x = F.when(F.abs(value) < float("inf"), F.col(value))
    return df.groupBy(*keys).agg(
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mu"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("sigma")
    )


def scale_channels(df: DataFrame, keys: list[str], value: str, moments: DataFrame, epsilon: float | None) -> DataFrame:
    """Z-score ``value`` by joined moments.

    With ``epsilon`` it is added to the deviation; without, a deviation near zero counts as one.
    """
    if epsilon is None:
        spread = F.when(F.col("sigma") > MIN_DEVIATION, F.col("sigma")).otherwise(1.0)
    else:
        spread = F.col("sigma") + epsilon
    joined = df.alias("l").join(moments.alias("r"), same_keys("l", "r", keys), "inner").select("l.*", "r.mu", "r.sigma")
    return joined.withColumn(value, (F.col(value) - F.col("mu")) / spread).drop("mu", "sigma")


def joint_minmax(df: DataFrame, keys: list[str], value: str, epsilon: float = 1e-8) -> DataFrame:
    """Min-max scaling per key over all sides together."""
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    scaled = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon)
    return df.join(bounds, keys, "inner").withColumn(value, scaled).drop("_lo", "_hi")


def dft(df: DataFrame, keys: list[str], ix: str, value: str, length: str, freqs: Column) -> DataFrame:
    """Fourier magnitudes per key: ``(keys, freq, mag)``.

    Each value meets each frequency of the array ``freqs``; sine and cosine sums combine on the map
    side, so only one row per key and frequency is shuffled. ``length`` is the transform length, zeros
    beyond the last row need no rows.
    """
    turns = F.pmod(F.col("freq") * F.col(ix), F.col(length)) / F.col(length)
    angle = turns * (2 * math.pi)
    waves = df.select(*keys, F.col(value).alias("_x"), F.col(ix), F.col(length), F.explode(freqs).alias("freq"))
    sums = waves.groupBy(*keys, "freq").agg(
        F.sum(F.col("_x") * F.cos(angle)).alias("_re"), F.sum(F.col("_x") * F.sin(angle)).alias("_im")
    )
    power = F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")
    return sums.select(*keys, "freq", F.sqrt(power).alias("mag"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rfft_magnitudes(series: pd.Series) -> pd.Series:
    return pd.Series(list(np.abs(np.fft.rfft(np.stack(series.to_numpy()), axis=1))))


def _wave_magnitudes(length: int):
    """Magnitudes from positions and values by direct sums: ``dft`` of whole series."""
    bins = length // 2 + 1
    angle = np.outer(np.arange(length), np.arange(bins)) % length / length * (2 * math.pi)
    waves = np.hstack([np.cos(angle), np.sin(angle)])
    step = max(1, TERMS_HELD // (length * 2 * bins))

    # Arrow keeps NaN and null apart, which pandas does not.
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def magnitudes(ix: pa.Array, value: pa.Array) -> pa.Array:
        found = [np.empty((0, bins))]
        for a in range(0, len(value), step):
            at, values = ix.slice(a, step), value.slice(a, step)
            starts = values.offsets.to_numpy()[:-1] - values.offsets[0].as_py()
            terms = values.flatten().to_numpy()[:, None] * waves[at.flatten().to_numpy() % length]
            sums = np.add.reduceat(terms, starts, axis=0)
            found.append(np.sqrt(np.square(sums[:, :bins]) + np.square(sums[:, bins:])))
        mags = np.concatenate(found)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(mags) + 1, dtype=np.int32) * bins), pa.array(mags.reshape(-1)))

    return magnitudes


def half_spectrum(df: DataFrame, keys: list[str], ix: str, value: str, length: int) -> DataFrame:
    """Magnitudes of the non-negative frequencies of dense series of one known ``length``.

    A row holds a whole series, which ``length`` bounds. Short ones are multiplied by a table of waves; from ``FFT_LENGTH``
    on, the quadratic cost of direct sums outweighs that of a fast transform.
    """
    if length < FFT_LENGTH:
        # A null value adds nothing; a series of nulls alone has no magnitudes.
        rows, known = F.collect_list(F.struct(F.col(ix).cast("long").alias("ix"), F.coalesce(value, F.lit(0.0)).alias("x"))), F.count(value) > 0
        whole = df.where(F.col(ix).isNotNull()).groupBy(*keys).agg(rows.alias("_rows"), known.alias("_known"))
        mags = whole.select(*keys, "_known", F.posexplode(_wave_magnitudes(length)("_rows.ix", "_rows.x")).alias("freq", "mag"))
        return mags.select(*keys, F.col("freq").cast("long"), F.when(F.col("_known"), F.col("mag")).alias("mag"))
    rows = F.array_sort(F.collect_list(F.struct(ix, value)))
    whole = df.groupBy(*keys).agg(F.transform(rows, lambda x: x[value]).alias("_series"))
    mags = whole.select(*keys, F.posexplode(_rfft_magnitudes("_series")).alias("freq", "mag"))
    return mags.withColumn("freq", F.col("freq").cast("long"))


def differences(
    df: DataFrame, keys: list[str], order: list[str], value: str, rows: int | None = None, kept: bool = False
) -> DataFrame:
    """Consecutive differences of ``value`` with their zero-based position ``ix``; ``kept`` as for ``ordered``."""
    steps = ordered(df, keys, order, rows, kept).lag(_before=value).numbered("ix").result()
    return steps.where("ix > 0").withColumns({value: F.col(value) - F.col("_before"), "ix": F.col("ix") - 1}).drop("_before")


def _uniform(projection: Column, dimension: Column, shift: int) -> Column:
    r, d = projection + 1 + shift, dimension + 1
    m = F.lit(HASH_MOD)
    # Reducing the squares first keeps the products inside 64 bits for any dimension.
    mixed = F.pmod(r * r, m) * HASH_A + F.pmod(d * d, m) * HASH_B + F.pmod(r * d, m) * HASH_C
    return (F.pmod(mixed, m) + 0.5) / HASH_MOD


def direction(projection: Column, dimension: Column) -> Column:
    """Standard-normal component of a fixed projection direction, from an integer hash."""
    u, v = _uniform(projection, dimension, 0), _uniform(projection, dimension, HASH_SECOND)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * math.pi * v)


def directions(dims: np.ndarray, projections: int) -> np.ndarray:
    """``direction`` of every dimension (rows) and projection (columns)."""
    d = dims.astype(np.int64)[:, None] + 1

    def uniform(shift: int) -> np.ndarray:
        r = np.arange(projections, dtype=np.int64)[None, :] + 1 + shift
        mixed = r * r % HASH_MOD * HASH_A + d * d % HASH_MOD * HASH_B + r * d % HASH_MOD * HASH_C
        return (mixed % HASH_MOD + 0.5) / HASH_MOD

    return np.sqrt(-2.0 * np.log(uniform(0))) * np.cos(2 * math.pi * uniform(HASH_SECOND))


def _ray_sums(batches, keys: list[str], projections: int):
    for batch in batches:
        if batch.num_rows == 0:
            continue
        coded = [batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
        order = np.lexsort(coded[::-1])
        codes = np.column_stack(coded)[order]
        starts = np.concatenate([[0], 1 + np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1))])
        dims, at = np.unique(batch.column("_dim").to_numpy()[order], return_inverse=True)
        rays = directions(dims, projections)[at]
        # A null value adds nothing, yet its dimension counts for the length of the direction.
        value = batch.column("_value").fill_null(0.0).to_numpy(zero_copy_only=False)[order]
        known = np.asarray(batch.column("_value").is_valid())[order]
        sums = np.add.reduceat(value[:, None] * rays, starts, axis=0)
        lengths = np.add.reduceat(np.square(rays), starts, axis=0)
        any_value = np.add.reduceat(known, starts) > 0
        first, ends = pa.array(order[starts]), pa.array(np.arange(len(starts) + 1, dtype=np.int32) * projections)
        arrays = [batch.column(k).take(first) for k in keys]
        arrays += [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (sums, lengths)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(any_value)], names=[*keys, "_sums", "_lengths", "_any"])


def ray_parts(vectors: DataFrame, keys: list[str], dim: str, value: str, projections: int) -> DataFrame:
    """``keys, _sums, _lengths, _any``: ``ray_sums`` with an array over the projections, and whether any value is known.

    A task adds up all projections of the rows it has of a key, so rows are not copied per projection; a key may
    come up several times.
    """
    rows = vectors.select(*keys, F.col(dim).cast("long").alias("_dim"), F.col(value).cast("double").alias("_value"))
    fields = [rows.schema[k] for k in keys]
    fields += [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_sums", "_lengths")] + [T.StructField("_any", T.BooleanType())]
    return rows.mapInArrow(partial(_ray_sums, keys=keys, projections=projections), T.StructType(fields))


def ray_sums(vectors: DataFrame, keys: list[str], dim: str, value: str, projections: int) -> DataFrame:
    """Inner products with directions that are not yet scaled, and the squared lengths of these: ``(keys, projection, part, length)``."""
    return unfolded_rays(ray_parts(vectors, keys, dim, value, projections), keys)


def unfolded_rays(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per projection from the arrays of ``ray_parts``."""
    long = parts.select(*keys, "_any", F.posexplode(F.arrays_zip("_sums", "_lengths")).alias("projection", "x"))
    return long.select(*keys, F.col("projection").cast("long"), F.when(F.col("_any"), F.col("x._sums")).alias("part"), F.col("x._lengths").alias("length"))


def projected(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Inner products with unit directions from ``ray_sums``: ``(keys, projection, projected)``."""
    return sums.groupBy(*keys, "projection").agg((F.sum("part") / F.sqrt(F.sum("length"))).alias("projected"))


def project(vectors: DataFrame, keys: list[str], dim: str, value: str, projections: int) -> DataFrame:
    """Inner products with unit directions: ``(keys, projection, projected)``. Vectors are dense in ``dim``."""
    return projected(ray_sums(vectors, keys, dim, value, projections), keys)


def sliced_wasserstein(projected: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Mean over projections of the one-dimensional Wasserstein-1 distance between the sides."""
    group = [*keys, "projection"]
    counts = value_counts(projected, group, "projected")
    per_ray = ecdf_distances(counts, group, "projected", rows)
    return per_ray.groupBy(*keys).agg(F.avg("w1").alias("distance"))


def _ray_values(batches, entity: list[str], part: str):
    """Projections of whole vectors and of their parts: per name (``*`` for whole vectors) and ray, the values of either side."""
    for table, starts in whole_pieces(batches, entity, RAYS_GATHERED):
        of_row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        sums, lengths = (table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) for c in ("_sums", "_lengths"))
        some = table.column("_any").to_numpy()
        side = table.column(SYNTH).combine_chunks().take(pa.array(starts))
        synth, sided = side.fill_null(False).to_numpy(zero_copy_only=False), np.asarray(side.is_valid())
        coded = table.column(part).combine_chunks().dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy()
        for name, rows in [("*", np.arange(table.num_rows)), *((n, np.flatnonzero(codes == k)) for k, n in enumerate(names))]:
            vectors, first = np.unique(of_row[rows], return_index=True)
            known = np.add.reduceat(some[rows].astype(np.int64), first) > 0
            if not known.any():
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                values = np.add.reduceat(sums[rows], first, axis=0) / np.sqrt(np.add.reduceat(lengths[rows], first, axis=0))
            rays = values.shape[1]
            arrays = [pa.array([name] * rays), pa.array(np.arange(rays))]
            for here in (~synth, synth):
                picked = values[known & sided[vectors] & here[vectors]].T
                ends = pa.array(np.arange(rays + 1, dtype=np.int32) * picked.shape[1])
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(picked.reshape(-1))))
            yield pa.RecordBatch.from_arrays(arrays, names=["feature", "projection", "real", "synth"])


def transport(real: np.ndarray, synth: np.ndarray) -> float | None:
    """Wasserstein-1 distance of two samples; None if one is empty."""
    if not len(real) or not len(synth):
        return None
    real, synth = np.sort(real), np.sort(synth)
    points = np.unique(np.concatenate([real, synth]))
    gap = np.searchsorted(real, points, "right") / len(real) - np.searchsorted(synth, points, "right") / len(synth)
    with np.errstate(invalid="ignore"):
        return float(np.sum(np.abs(gap[:-1]) * np.diff(points)))


def _transport(table: pa.Table) -> pa.Table:
    sides = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("real", "synth")]
    return pa.table({"feature": table.column("feature").slice(0, 1), "w1": pa.array([transport(*sides)], pa.float64())})


def sliced_wasserstein_by_ray(parts: DataFrame, entity: list[str], part: str) -> DataFrame:
    """``feature, distance``: ``sliced_wasserstein`` of whole vectors (``*``) and of their parts, from ``ray_parts`` by entity and part.

    The values of a ray come as arrays and are sorted in one task, so there may be no more entities than a segment has rows.
    """
    near = parts.repartition(*entity).sortWithinPartitions(*entity)
    lists = "feature string, projection long, real array<double>, synth array<double>"
    values = near.mapInArrow(partial(_ray_values, entity=entity, part=part), lists)
    per_ray = values.groupBy("feature", "projection").applyInArrow(_transport, "feature string, w1 double")
    return per_ray.groupBy("feature").agg(F.avg("w1").alias("distance"))
