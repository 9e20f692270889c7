"""Correlations of all column pairs from one pass over whole rows.

A task adds up, per key and side, the co-moment matrix of all columns over the rows where both of a pair are known: products of
matrices for keys with many rows in a batch, sums over sorted runs for keys with few. Rows are never copied per pair;
one row per key and pair leaves a task. The sums are taken around values near the columns' means, found in a few rows, so
that large offsets do not eat the digits; these centres steer rounding only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.functions.numeric import to_double
from chronofid.operators.distributions import SYNTH
from chronofid.operators.shape import FEATURE, pair_name

#: Rows whose means serve as centres.
CENTRE_ROWS = 1000
#: Rows per key from which matrices are multiplied, and sums that a task holds before it sends them on.
FEW, HELD = 32, 1 << 20
SUMS = ["n", "bad", "a", "b", "aa", "bb", "ab"]
ENDS = ["low_a", "low_b", "high_a", "high_b"]


def _by_products(x: np.ndarray, known: np.ndarray, bad: np.ndarray, raw: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and ends of every pair over the rows of one key."""
    k, sq = known.astype(np.float64), np.square(x)
    n, s, ss, off = k.T @ k, x.T @ k, sq.T @ k, bad.astype(np.float64).T @ k
    sums = np.stack([n[i, j], off[i, j] + off[j, i], s[i, j], s[j, i], ss[i, j], ss[j, i], (x.T @ x)[i, j]])
    low, high = np.empty(n.shape), np.empty(n.shape)
    whole = known.all(axis=0)
    least, most = np.where(known, raw, np.inf), np.where(known, raw, -np.inf)
    low[:, whole], high[:, whole] = least.min(axis=0)[:, None], most.max(axis=0)[:, None]
    for c in np.flatnonzero(~whole):
        rows = known[:, c]
        low[:, c], high[:, c] = least[rows].min(axis=0, initial=np.inf), most[rows].max(axis=0, initial=-np.inf)
    return sums, np.stack([low[i, j], low[j, i], high[i, j], high[j, i]])


def _by_runs(x: np.ndarray, known: np.ndarray, bad: np.ndarray, raw: np.ndarray, i: np.ndarray, j: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many keys at once, each a run of rows."""
    both = known[:, i] & known[:, j]
    a, b = np.where(both, x[:, i], 0.0), np.where(both, x[:, j], 0.0)
    off = (bad[:, i] | bad[:, j]) & both
    sums = np.stack([np.add.reduceat(v, starts, axis=0, dtype=np.float64) for v in (both, off, a, b, a * a, b * b, a * b)])
    ends = [np.minimum.reduceat(np.where(both, raw[:, c], np.inf), starts, axis=0) for c in (i, j)]
    ends += [np.maximum.reduceat(np.where(both, raw[:, c], -np.inf), starts, axis=0) for c in (i, j)]
    return sums, np.stack(ends)


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], cols: list[str], pairs: list[tuple[int, int]], centres: list[float]) -> Iterator[pa.RecordBatch]:
    i, j = (np.array(v) for v in zip(*pairs))
    held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    types: list[pa.DataType] = []

    def add(name: tuple, sums: np.ndarray, ends: np.ndarray) -> None:
        if name in held:
            s, e = held[name]
            s += sums
            e[:2], e[2:] = np.minimum(e[:2], ends[:2]), np.maximum(e[2:], ends[2:])
        else:
            held[name] = sums.copy(), ends.copy()

    def settled() -> pa.RecordBatch:
        names, sums, ends = list(held), np.stack([s for s, _ in held.values()]), np.stack([e for _, e in held.values()])
        held.clear()
        at, pair = np.nonzero(sums[:, 0] > 0)
        arrays = [pa.array([names[k][c] for k in at.tolist()], types[c]) for c in range(len(keys))]
        arrays.append(pa.array(pair, pa.int32()))
        arrays += [pa.array(sums[at, c, pair]) for c in range(len(SUMS))] + [pa.array(ends[at, c, pair]) for c in range(len(ENDS))]
        return pa.RecordBatch.from_arrays(arrays, names=[*keys, "pair", *(f"_{c}" for c in SUMS + ENDS)])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        types = [batch.column(k).type for k in keys]
        columns = [batch.column(c) for c in cols]
        known = np.column_stack([np.asarray(c.is_valid()) for c in columns])
        raw = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns])
        finite = np.isfinite(raw)
        bad = known & ~finite
        x = np.where(known & finite, raw - np.array(centres), 0.0)
        coded = [batch.column(k).dictionary_encode() for k in keys]
        codes = np.column_stack([c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in coded])
        _, first, of_row = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        names = list(zip(*(batch.column(k).take(pa.array(first)).to_pylist() for k in keys)))
        order = np.argsort(of_row.reshape(-1), kind="stable")
        starts = np.searchsorted(of_row.reshape(-1)[order], np.arange(len(first)))
        parts = [v[order] for v in (x, known, bad, raw)]
        if len(first) * FEW <= batch.num_rows:
            for name, a, b in zip(names, starts, [*starts[1:], len(order)]):
                add(name, *_by_products(*(v[a:b] for v in parts), i, j))
        else:
            # A slice of the pairs at a time, so that no product of rows and pairs is large.
            step = max(1, (4 << 20) // batch.num_rows)
            pieces = [_by_runs(*parts, i[p : p + step], j[p : p + step], starts) for p in range(0, len(i), step)]
            sums, ends = (np.concatenate(v, axis=2) for v in zip(*pieces))
            for k, name in enumerate(names):
                add(name, sums[:, k], ends[:, k])
        if len(held) * len(i) > HELD:
            yield settled()
    if held:
        yield settled()


def pair_correlations(df: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """``keys, feature, real_n, real_rho, synth_n, synth_rho`` of each column pair over its complete rows.

    Rho is null if a side has under two rows or a constant column, NaN if it has a value that is not finite.
    """
    cols = sorted({c for p in pairs for c in p})
    groups = [*keys, SYNTH]
    wide = df.select(*groups, *[to_double(c).alias(f"_x{k}") for k, c in enumerate(cols)])
    values = [f"_x{k}" for k in range(len(cols))]
    some = wide.select(*values).limit(CENTRE_ROWS).agg(*[F.avg(c) for c in values]).first()
    centres = [x if x is not None and np.isfinite(x) else 0.0 for x in some]
    fields = [wide.schema[k] for k in groups] + [T.StructField("pair", T.IntegerType())]
    fields += [T.StructField(f"_{c}", T.DoubleType()) for c in SUMS + ENDS]
    schema = T.StructType(fields)
    numbered = [(cols.index(a), cols.index(b)) for a, b in pairs]
    sums = wide.mapInArrow(partial(_partial, keys=groups, cols=values, pairs=numbered, centres=centres), schema)
    merged = [F.sum(f"_{c}").alias(f"_{c}") for c in SUMS]
    merged += [(F.min if c.startswith("low") else F.max)(f"_{c}").alias(f"_{c}") for c in ENDS]
    per_side = sums.groupBy(*groups, "pair").agg(*merged)
    n = F.col("_n")
    cov = F.col("_ab") / n - F.col("_a") / n * (F.col("_b") / n)
    spread = F.sqrt(F.col("_aa") / n - F.pow(F.col("_a") / n, 2)) * F.sqrt(F.col("_bb") / n - F.pow(F.col("_b") / n, 2))
    varies = (n > 1) & (F.col("_low_a") < F.col("_high_a")) & (F.col("_low_b") < F.col("_high_b"))
    rho = F.when(F.col("_bad") > 0, F.lit(float("nan"))).when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, spread))))
    sides = per_side.withColumn("_rho", rho)
    of = lambda side, c: F.max(F.when(F.col(SYNTH) == F.lit(side), F.col(c)))
    count = lambda side: F.coalesce(of(side, "_n"), F.lit(0.0)).cast("long")
    out = sides.groupBy(*keys, "pair").agg(
        count(False).alias("real_n"), of(False, "_rho").alias("real_rho"), count(True).alias("synth_n"), of(True, "_rho").alias("synth_rho")
    )
    names = F.array(*[F.lit(pair_name(a, b)) for a, b in pairs])
    return out.select(*keys, F.get(names, F.col("pair")).alias(FEATURE), "real_n", "real_rho", "synth_n", "synth_rho")
