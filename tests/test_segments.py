"""A hot key cut into segments must give what the plain windows give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofid.operators import ordered as ordered_module
from chronofid.operators.distributions import ecdf_distances, ks_by, medians, value_counts, weighted_medians
from chronofid.operators.ordered import SEG, ordered
from chronofid.plans import trajectories as tr
from chronofid.plans.columns import entity_statistics
from chronofid.session import SEGMENT_CONF, checkpointed


@pytest.fixture()
def cut(spark):
    """Run a function with plain windows and again with segments of 40 rows."""

    def both(run):
        plain = run()
        spark.conf.set(SEGMENT_CONF, "40")
        try:
            return plain, run()
        finally:
            spark.conf.unset(SEGMENT_CONF)

    return both


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    n = 900
    data = [
        (
            int(i), None if k == 9 else int(k), int(t), None if v < 0.3 else float(round(v * 10, 1)), bool(s),
        )
        for i, k, t, v, s in zip(
            range(n), np.where(rng.random(n) < 0.5, 0, rng.integers(1, 10, n)), rng.integers(0, 60, n), rng.random(n), rng.random(n) < 0.5
        )
    ]
    return spark.createDataFrame(data, "row_ix long, k long, t long, v double, is_synth boolean").cache()


def same(a, b):
    def close(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
        return x == y

    assert len(a) == len(b)
    assert all(close(x, y) for left, right in zip(a, b) for x, y in zip(left, right))


@pytest.mark.parametrize("keys", [["k"], [], ["is_synth", "k"]])
def test_row_order_operators(rows, cut, keys):
    split = []

    def run():
        o = ordered(rows, keys, ["t", "row_ix"])
        split.append(o.split)
        o = o.lag(before="v", before_t="t").lead(after="v").running(total="v").numbered("pos")
        o = o.previous_known(known="v").next_known(coming="v")
        return sorted(map(tuple, o.result().select("row_ix", "before", "before_t", "after", "total", "pos", "known", "coming").collect()))

    plain, segmented = cut(run)
    assert split == [False, True]
    same(plain, segmented)


def test_ks_and_medians(rows, cut):
    def run():
        ks = ks_by(rows, [], "v", rows.count()).collect()
        by_key = ks_by(rows, ["k"], "v", rows.count()).orderBy("k").select("k", "ks", "w1").collect()
        mid = medians(rows, ["k"], {"m": "v", "mt": "t"}, rows.count()).orderBy("k").select("k", "m", "mt").collect()
        one = medians(rows, [], {"m": "v"}, rows.count()).collect()
        return [*ks, *by_key, *mid, *one]

    plain, segmented = cut(run)
    same(plain, segmented)


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 3), (1, 2.0, 1), (1, 9.0, 2), (2, 5.0, 1), (2, 7.0, 1)], "k long, x double, n long")
    assert {r["k"]: r["median"] for r in weighted_medians(df, ["k"], "x", "n").collect()} == {1: 1.5, 2: 6.0}


def test_ks_equals_numpy(rows):
    data = rows.where("v is not null").toPandas()
    a, b = np.sort(data[~data.is_synth].v), np.sort(data[data.is_synth].v)
    at = np.concatenate([a, b])
    want = np.abs(np.searchsorted(a, at, "right") / len(a) - np.searchsorted(b, at, "right") / len(b)).max()
    assert ks_by(rows, [], "v").first()["ks"] == pytest.approx(want, abs=1e-12)


def test_autocorrelation_of_a_long_series(rows, cut):
    def run():
        known = rows.where(F.col("k").isNotNull())
        return sorted(map(tuple, tr.autocorrelation(known, ["k"], ["t", "row_ix"], "v", 7).collect()))

    plain, segmented = cut(run)
    same(plain, segmented)
    data = rows.where("k = 0 and v is not null").orderBy("t", "row_ix").toPandas().v.to_numpy()
    centred = data - data.mean()
    want = [(centred[:-h] * centred[h:]).mean() / data.var() for h in range(1, 8)]
    got = [r[2] for r in plain if r[0] == 0]
    assert got == pytest.approx(want, abs=1e-9)


@pytest.fixture()
def segments_of_400(spark):
    spark.conf.set(SEGMENT_CONF, "400")
    yield
    spark.conf.unset(SEGMENT_CONF)


def test_pieces_of_a_cut_key_are_far_smaller_than_a_segment(rows, segments_of_400):
    o = ordered(rows, [], ["t", "row_ix"])
    sizes = [r["count"] for r in o.df.groupBy(SEG).count().collect()]
    assert o.split and sum(sizes) == 900 and max(sizes) <= 100


def test_statistics_of_many_small_groups_need_no_window(spark, segments_of_400):
    df = spark.range(1500).select((F.col("id") % 500).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    found = entity_statistics(df, ["k"], "v")
    assert "Window" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        values = [float((r["k"] + 500 * i) * 37 % 101) for i in range(3)]
        assert (r["count"], r["median"], r["min"], r["max"]) == (3, np.median(values), min(values), max(values))
        assert r["mean"] == pytest.approx(np.mean(values)) and r["std"] == pytest.approx(np.std(values, ddof=1))


def test_statistics_of_groups_agree_with_a_large_one_and_a_null_key(rows, cut):
    run = lambda: [tuple(r) for r in entity_statistics(rows, ["k"], "v").orderBy("k").collect()]
    plain, counted = run(), cut(run)[1]
    same(plain, counted)
    assert plain[0][0] is None and dict(zip(entity_statistics(rows, ["k"], "v").columns, plain[0]))["median"] is None


def test_a_checkpoint_is_not_written_again(rows, segments_of_400, monkeypatch):
    counts = checkpointed(value_counts(rows.withColumn("v", F.col("row_ix").cast("double")), [], "v"))
    written = []
    monkeypatch.setattr(ordered_module, "checkpointed", lambda df: written.append(df) or checkpointed(df))
    ks = ecdf_distances(counts, [], "v", 900, kept=True).first()["ks"]
    assert len(written) == 1
    assert ks == pytest.approx(ecdf_distances(counts, [], "v", 300).first()["ks"])
