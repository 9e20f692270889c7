"""Pair statistics from whole rows against NumPy and pandas, with nulls, odd values and hot keys."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronofid.operators import contingency, moments
from chronofid.operators.correlation import pair_corr
from chronofid.operators.shape import column_pairs, unpivot_pairs

COLS = ["a", "b", "c", "d", "e"]


def rows(n, keys, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=n)
    df = pd.DataFrame({"k": np.where(rng.random(n) < 0.4, 0, rng.integers(0, keys, n)), "is_synth": rng.random(n) < 0.5})
    df["a"] = base
    df["b"] = 1e9 + base * 0.5 + rng.normal(size=n)
    df["c"] = 7.25
    df["d"] = np.where(rng.random(n) < 0.3, None, rng.normal(size=n))
    df["e"] = np.where(rng.random(n) < 0.9, None, base)
    return df


def frame(spark, df):
    listed = [tuple(None if isinstance(x, float) and math.isnan(x) or x is None else x for x in r) for r in df.itertuples(index=False, name=None)]
    return spark.createDataFrame([(int(k) if k is not None else None, bool(s), *x) for k, s, *x in listed], "k long, is_synth boolean, " + ", ".join(f"{c} double" for c in COLS))


@pytest.mark.parametrize("n, keys", [(3000, 4), (900, 400)])
def test_correlations_equal_those_of_numpy(spark, n, keys):
    df = rows(n, keys)
    got = moments.pair_correlations(frame(spark, df).repartition(3), ["k"], column_pairs(COLS)).collect()
    found = {(r.k, r.feature): r for r in got}
    seen = 0
    for (k, synth), part in df.groupby(["k", "is_synth"]):
        for a, b in combinations(COLS, 2):
            both = part[[a, b]].dropna().astype(float)
            if not len(both):
                continue
            r = found[k, f"{a} x {b}"]
            assert (r.synth_n if synth else r.real_n) == len(both)
            rho = r.synth_rho if synth else r.real_rho
            if len(both) < 2 or both[a].nunique() == 1 or both[b].nunique() == 1:
                assert rho is None
            else:
                assert rho == pytest.approx(np.corrcoef(both[a], both[b])[0, 1], abs=1e-6)
                seen += 1
    assert seen > 20


def test_correlations_equal_those_of_copied_rows(spark):
    df = frame(spark, rows(500, 30, 3)).withColumn("k", F.when(F.col("k") < 25, F.col("k")))
    pairs = column_pairs(COLS)
    old = pair_corr(unpivot_pairs(df, ["is_synth", "k"], pairs, numbers=True), ["feature", "k"]).collect()
    new = moments.pair_correlations(df, ["k"], pairs).collect()
    key = lambda r: (r.feature, r.k is None, r.k)
    assert {key(r): (r.real_n, r.synth_n) for r in old} == {key(r): (r.real_n, r.synth_n) for r in new}
    by = {key(r): r for r in new}
    for r in old:
        for x, y in ((r.real_rho, by[key(r)].real_rho), (r.synth_rho, by[key(r)].synth_rho)):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6))


def test_values_that_are_not_finite_and_no_rows(spark):
    df = spark.createDataFrame([(False, 1.0, float("inf"), 1.0), (False, 2.0, 5.0, 3.0), (False, 4.0, 6.0, None)], "is_synth boolean, a double, b double, c double")
    got = {r.feature: r for r in moments.pair_correlations(df, [], [("a", "b"), ("a", "c"), ("b", "c")]).collect()}
    assert math.isnan(got["a x b"].real_rho) and math.isnan(got["b x c"].real_rho)
    assert got["a x c"].real_rho == pytest.approx(1.0) and got["a x c"].synth_n == 0 and got["a x c"].synth_rho is None
    assert moments.pair_correlations(df.where("a > 9"), [], [("a", "b")]).count() == 0


def test_rows_are_not_copied_for_pairs(spark):
    df = frame(spark, rows(50, 3))
    plans = [
        moments.pair_correlations(df, ["k"], column_pairs(COLS)),
        contingency.pair_distances(df, ["k"], column_pairs(COLS), nulls=True),
    ]
    for plan in plans:
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "inline" not in text and "Generate" not in text


@pytest.mark.parametrize("nulls", [True, False])
def test_pair_tables_equal_those_of_pandas(spark, nulls):
    rng = np.random.default_rng(6)
    n = 600
    df = pd.DataFrame({"k": rng.integers(0, 3, n), "is_synth": rng.random(n) < 0.4})
    for c, values in (("x", ["u", "v", None, ""]), ("y", ["=", "u", None]), ("z", [str(i) for i in range(40)])):
        df[c] = rng.choice(np.array(values, dtype=object), n)
    made = spark.createDataFrame([tuple(x.item() if hasattr(x, "item") else x for x in r) for r in df.itertuples(index=False, name=None)], "k long, is_synth boolean, x string, y string, z string")
    got = {(r.k, r.feature): r for r in contingency.pair_distances(made, ["k"], column_pairs(["x", "y", "z"]), nulls).collect()}
    for k, part in df.groupby("k"):
        for a, b in combinations(["x", "y", "z"], 2):
            known = part if nulls else part.dropna(subset=[a, b])
            share = [known[known.is_synth == s].groupby([a, b], dropna=False).size() for s in (False, True)]
            p, q = (s / s.sum() for s in share)
            tvd = 0.5 * p.subtract(q, fill_value=0).abs().sum()
            r = got[k, f"{a} x {b}"]
            assert (r.n_real, r.n_synth) == (share[0].sum(), share[1].sum()) and r.tvd == pytest.approx(tvd, abs=1e-12)
