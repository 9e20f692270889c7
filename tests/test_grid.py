"""Chunked grids, run overlaps and lagged products against plain counting."""

import random
from collections import Counter
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofid.operators import grid, lagged


@pytest.mark.parametrize("chunk", [4096, 3])
def test_points_of_spans(spark, monkeypatch, chunk):
    monkeypatch.setattr(grid, "CHUNK", chunk)
    spans = spark.createDataFrame([("a", 5, 17), ("b", 4, 4), ("c", 9, 3), ("d", -7, 0), ("e", None, 4)], "key string, first long, last long")
    for step in (1, 5):
        got = sorted(map(tuple, grid.stepped(spans, ["key"], "first", "last", step, "t").collect()))
        assert got == [(k, t) for k, lo, hi in (("a", 5, 17), ("b", 4, 4), ("d", -7, 0)) for t in range(lo, hi + 1, step)]
    days = spark.createDataFrame([("a", date(2024, 1, 30), date(2024, 3, 2)), ("b", date(2024, 5, 1), date(2024, 5, 1))], "key string, first date, last date")
    got = grid.stepped(days, ["key"], "first", "last", "day", "t")
    want = days.select("key", F.explode(F.expr("sequence(first, last, interval 1 day)")).alias("t"))
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect()) and got.count() == 34
    for kind in ("timestamp", "timestamp_ntz", "date"):
        months = spark.createDataFrame([("a", datetime(2023, 1, 1, 6, 30), datetime(2024, 2, 1, 6, 29)), ("b", datetime(2023, 3, 1), datetime(2023, 4, 1))], "key string, first timestamp_ntz, last timestamp_ntz")
        months = months.select("key", F.col("first").cast(kind), F.col("last").cast(kind))
        got = grid.stepped(months, ["key"], "first", "last", "month", "t")
        want = months.select("key", F.explode(F.expr("sequence(first, last, interval 1 month)")).alias("t"))
        assert got.schema["t"].dataType == want.schema["t"].dataType and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_an_endless_span_is_dealt_out(spark):
    spans = spark.createDataFrame([("hot", 0, 20_000_000), *((f"k{i}", i, i + 3) for i in range(50))], "key string, first long, last long")
    points = grid.stepped(spans, ["key"], "first", "last", 1, "t")
    per_task = [r["count"] for r in points.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per_task) == 20_000_001 + 200 and max(per_task) < 0.2 * sum(per_task)


def counted(runs, cells):
    r, s = Counter(), Counter(cells)
    for lo, n in runs:
        r.update(range(lo, lo + n))
    shared = [c for c in r if s[c]]
    return sum(r.values()), sum(min(r[c], s[c]) for c in r), len(r), len(shared), sum(r[c] for c in shared)


@pytest.mark.parametrize("segment", [None, 20])
def test_overlap_of_runs_and_cells(spark, segment):
    draw = random.Random(3)
    runs = [(draw.randrange(-50, 50), draw.randrange(1, 30)) for _ in range(40)]
    cells = [draw.randrange(-80, 120) for _ in range(150)]
    if segment:
        spark.conf.set("spark.chronofid.segmentRows", str(segment))
    try:
        got = grid.overlap(spark.createDataFrame(runs, "lo long, n long"), spark.createDataFrame([(c,) for c in cells], "cell long")).first()
    finally:
        spark.conf.unset("spark.chronofid.segmentRows")
    assert (got.total, got.covered, got.support, got.shared, got.shared_mass) == counted(runs, cells)


def test_a_run_of_a_billion_cells(spark):
    runs = spark.createDataFrame([(7, 1_000_000_000), (10, 5)], "lo long, n long")
    cells = spark.createDataFrame([(12,), (12,), (12,), (999_999_999,), (2_000_000_000,)], "cell long")
    got = grid.overlap(runs, cells).first()
    assert tuple(got) == (1_000_000_005, 3, 1_000_000_000, 2, 3)


@pytest.mark.parametrize("lags", [3, 40, 90])
def test_products_of_pieces(lags):
    rng = np.random.default_rng(lags)
    sizes = [1, 2, 5, 100, 130, 400]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = rng.normal(size=sum(sizes))
    home = np.concatenate([np.arange(n) < max(1, n - (lags if k % 2 else 0)) for k, n in enumerate(sizes)])
    sums, counts = lagged.products(x, home, starts, lags)
    for k, (a, n) in enumerate(zip(starts, sizes)):
        for lag in range(1, lags + 1):
            pairs = [(i, i + lag) for i in range(n) if home[a + i] and i + lag < n]
            assert counts[k, lag - 1] == len(pairs)
            assert sums[k, lag - 1] == pytest.approx(sum(x[a + i] * x[a + j] for i, j in pairs), abs=1e-9)


@pytest.mark.parametrize("lags", [2, 70])
def test_means_of_products_across_batches(spark, lags):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        rng = np.random.default_rng(1)
        rows = [(k, 0, i, float(v), True) for k, n in ((None, 150), ("a", 400), ("b", 3)) for i, v in enumerate(rng.normal(size=n))]
        df = spark.createDataFrame(rows, "k string, piece long, pos long, _x double, _home boolean")
        got = {(r.k, r.lag): r.product for r in lagged.lagged_means(df, ["k"], lags).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k in (None, "a", "b"):
        x = np.array([r[3] for r in rows if r[0] == k])
        want |= {(k, lag): (x[:-lag] * x[lag:]).mean() for lag in range(1, min(lags, len(x) - 1) + 1)}
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c], abs=1e-9) for c in want)


def test_projections_equal_those_of_copied_rows(spark):
    from chronofid.operators import spectra

    rng = np.random.default_rng(0)
    rows = [(k, "x" if d % 2 else None, d, float(rng.normal()) if (k, d) != (3, 4) else None) for k in range(40) for d in range(9)]
    vectors = spark.createDataFrame(rows, "k long, c string, dim long, v double").repartition(3)
    got = {(r.k, r.c, r.projection): r.projected for r in spectra.project(vectors, ["k", "c"], "dim", "v", 50).collect()}
    spread = vectors.withColumn("projection", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))))
    part = spectra.direction(F.col("projection"), F.col("dim"))
    want = spread.groupBy("k", "c", "projection").agg((F.sum(F.col("v") * part) / F.sqrt(F.sum(part * part))).alias("p")).collect()
    assert len(want) == len(got) == 40 * 2 * 50
    assert all(got[r.k, r.c, r.projection] == pytest.approx(r.p, abs=1e-12) for r in want)
