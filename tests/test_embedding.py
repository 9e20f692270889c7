"""Spectral embedding: shape, short and broken trajectories, scaling, symmetry, determinism."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofid.functions.vectors import l1_distance, l2_distance, squared_distance
from chronofid.operators.spectra import FFT_LENGTH, dft, half_spectrum, joint_minmax
from chronofid.plans import embedding
from chronofid.plans.roles import TableRoles

ROLES = TableRoles(key="id", time="t", row="row_ix", num_cols=["a", "b", "c"])


def frame(spark, lengths, seed=0, broken=None):
    rng = np.random.default_rng(seed)
    rows, data = [], {}
    for key, n in enumerate(lengths):
        x = rng.normal(size=(n, 3))
        data[key] = x
        for t in range(n):
            v = [float(q) for q in x[t]]
            if broken == (key, t):
                v[1] = float("nan")
            rows.append((key, t, *v, len(rows)))
    return spark.createDataFrame(rows, "id long, t long, a double, b double, c double, row_ix long"), data


def expected(x, f=8):
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
    d = np.diff(z, axis=0)
    d = np.vstack([d, np.zeros((max(0, f - len(d)), x.shape[1]))])
    return np.abs(np.fft.fft(d, axis=0)[:f]).ravel(order="F")


def vectors(df, **options):
    return {r["id"]: np.array(r["vec"]) for r in embedding.vectors(embedding.magnitudes(df, ROLES, **options), ["id"]).collect()}


def test_shape_and_values(spark):
    df, data = frame(spark, [5, 12, 20, 9])
    got = vectors(df)
    assert all(len(v) == 24 for v in got.values())
    for key, x in data.items():
        assert got[key] == pytest.approx(expected(x), abs=1e-9)


def test_short_trajectories_are_skipped(spark):
    df, _ = frame(spark, [1, 6])
    assert set(vectors(df)) == {1}
    row = embedding.report(df, ROLES).first()
    assert (row["n_total"], row["n_skipped_short"], row["n_kept"]) == (2, 1, 1)


def test_short_trajectories_can_be_zero(spark):
    df, _ = frame(spark, [1, 6])
    got = vectors(df, pad_short=True)
    assert got[0] == pytest.approx(np.zeros(24)) and embedding.report(df, ROLES, pad_short=True).first()["n_kept"] == 2


def test_two_rows_are_zero_padded(spark):
    df, data = frame(spark, [2])
    assert vectors(df)[0] == pytest.approx(expected(data[0]), abs=1e-9)


def test_broken_values_raise_or_skip(spark):
    df, _ = frame(spark, [6, 6], broken=(0, 3))
    with pytest.raises(ValueError, match="missing or infinite"):
        embedding.magnitudes(df, ROLES)
    assert set(vectors(df, on_nan="skip")) == {1}
    assert embedding.report(df, ROLES).first()["n_skipped_nan"] == 1


def test_minmax_range(spark):
    df, _ = frame(spark, [5, 8, 13])
    scaled = joint_minmax(embedding.magnitudes(df, ROLES), ["dim"], "mag").agg(F.min("mag"), F.max("mag")).first()
    assert scaled[0] == 0.0 and 0.9 < scaled[1] <= 1.0


def test_distances(spark):
    df, _ = frame(spark, [5, 8])
    a, b = vectors(df).values()
    row = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    ab, ba, aa, one, sq = row.select(
        l2_distance("a", "b"), l2_distance("b", "a"), l2_distance("a", "a"), l1_distance("a", "b"), squared_distance("a", "b")
    ).first()
    assert ab == ba == pytest.approx(np.linalg.norm(a - b)) and aa == 0.0
    assert one == pytest.approx(np.abs(a - b).sum()) and sq == pytest.approx(ab**2)


def test_same_result_twice_and_in_any_row_order(spark):
    df, _ = frame(spark, [7, 9])
    first, second = vectors(df), vectors(df.orderBy(F.desc("row_ix")))
    assert all(first[k] == pytest.approx(second[k], abs=1e-9) for k in first)


def test_ragged_lengths(spark):
    df, data = frame(spark, [3, 5, 8, 15, 30], seed=4)
    got = vectors(df)
    assert all(got[k] == pytest.approx(expected(x), abs=1e-9) for k, x in data.items())


def test_joint_moments(spark):
    df, data = frame(spark, [6, 10])
    whole = np.vstack(list(data.values()))
    got = vectors(df, moments=embedding.joint_moments(df, ROLES.num_cols))
    x = (data[0] - whole.mean(axis=0)) / (whole.std(axis=0) + 1e-8)
    d = np.vstack([np.diff(x, axis=0), np.zeros((3, 3))])
    assert got[0] == pytest.approx(np.abs(np.fft.fft(d, axis=0)[:8]).ravel(order="F"), abs=1e-9)


@pytest.mark.parametrize("length", [7, FFT_LENGTH + 3])
def test_both_transforms_equal_numpy(spark, length):
    x = np.random.default_rng(2).normal(size=length)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "id long, ix long, value double")
    got = [r["mag"] for r in half_spectrum(df, ["id"], "ix", "value", length).orderBy("freq").collect()]
    assert got == pytest.approx(np.abs(np.fft.rfft(x)), abs=1e-9)
    freqs = F.sequence(F.lit(0).cast("long"), F.lit(length // 2).cast("long"))
    direct = dft(df.withColumn("n", F.lit(length).cast("long")), ["id"], "ix", "value", "n", freqs)
    assert [r["mag"] for r in direct.orderBy("freq").collect()] == pytest.approx(got, abs=1e-9)
