"""Sums of products of values that lie a lag apart in their series, without a row per pair of values."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Above so many lags a piece is transformed instead of shifted.
SHIFTS = 64
#: Rows gathered before whole pieces are worked on.
GATHERED = 1 << 16


def _codes(table: pa.Table, names: list[str]) -> np.ndarray:
    """Numbers that tell the values of columns apart."""
    coded = [table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1) for c in names]
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in coded])


def whole_pieces(batches: Iterator[pa.RecordBatch], names: list[str], gathered: int = GATHERED) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pieces, and where each piece starts, from batches in which the rows of a piece follow each other."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        codes = _codes(table, names)
        return np.concatenate([[0], 1 + np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1))])

    rows, wanted = 0, gathered
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = cut(table)
        if len(starts) == 1:
            wanted = 2 * rows  # one long piece: look again when there is twice as much
            continue
        yield table.slice(0, int(starts[-1])).combine_chunks(), starts[:-1]
        held = table.slice(int(starts[-1])).combine_chunks().to_batches()
        rows, wanted = sum(b.num_rows for b in held), gathered
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def products(x: np.ndarray, home: np.ndarray, starts: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Per piece and lag 1 to ``lags``: sum and number of products of a home value with the value that many rows on."""
    ends = np.append(starts[1:], len(x))
    sums, counts = np.zeros((len(starts), lags)), np.zeros((len(starts), lags), np.int64)
    if lags <= SHIFTS:
        piece = np.repeat(np.arange(len(starts)), ends - starts)
        for lag in range(1, min(lags, len(x) - 1) + 1):
            ok = (piece[:-lag] == piece[lag:]) & home[:-lag]
            at = piece[:-lag][ok]
            sums[:, lag - 1] = np.bincount(at, (x[:-lag] * x[lag:])[ok], len(starts))
            counts[:, lag - 1] = np.bincount(at, minlength=len(starts))
        return sums, counts
    for k, (a, b) in enumerate(zip(starts, ends)):
        size = 1 << int(2 * (b - a) - 1).bit_length()
        near = np.fft.rfft(np.where(home[a:b], x[a:b], 0.0), size)
        most = min(lags, b - a - 1)
        sums[k, :most] = np.fft.irfft(near.conj() * np.fft.rfft(x[a:b], size), size)[1 : most + 1]
        # Home rows come first, so a lag loses the last ones that have no row that far on.
        reach = b - a - np.arange(1, most + 1)
        counts[k, :most] = np.minimum(int(home[a:b].sum()), reach)
    return sums, counts


def _run(batches: Iterator[pa.RecordBatch], keys: list[str], lags: int) -> Iterator[pa.RecordBatch]:
    for table, starts in whole_pieces(batches, [*keys, "piece"]):
        x, home = (table.column(c).to_numpy() for c in ("_x", "_home"))
        sums, counts = products(x, np.asarray(home, bool), starts, lags)
        first = pa.array(starts)
        ends = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * lags)
        arrays = [table.column(k).combine_chunks().take(first) for k in keys]
        arrays += [pa.ListArray.from_arrays(ends, pa.array(v.reshape(-1))) for v in (sums, counts)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "_sums", "_counts"])


def lagged_means(cut: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """``keys, lag, product``: mean product of values ``lag`` rows apart, from rows ``keys, piece, pos, _x, _home``.

    A piece holds the home rows of a stretch of its series and, after them, the next ``lags`` rows of the series with ``_home`` unset.
    """
    rows = cut.select(*keys, "piece", "pos", "_x", "_home").repartition(*keys, "piece").sortWithinPartitions(*keys, "piece", "pos")
    fields = [rows.schema[k] for k in keys]
    fields += [T.StructField("_sums", T.ArrayType(T.DoubleType())), T.StructField("_counts", T.ArrayType(T.LongType()))]
    parts = rows.mapInArrow(partial(_run, keys=keys, lags=lags), T.StructType(fields))
    long = parts.select(*keys, F.posexplode(F.arrays_zip("_sums", "_counts")).alias("at", "x")).where("x._counts > 0")
    total = long.groupBy(*keys, (F.col("at") + 1).alias("lag")).agg(F.sum("x._sums").alias("s"), F.sum("x._counts").alias("c"))
    return total.select(*keys, "lag", (F.col("s") / F.col("c")).alias("product"))
