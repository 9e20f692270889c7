"""Spectra and sliced distances from whole series and arrays of rays, against rows per frequency, rows per ray and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofid.operators import ordered as ordered_module
from chronofid.operators import spectra
from chronofid.plans import panel
from chronofid.plans import trajectories as tr
from chronofid.plans.metrics import Scan, evaluate
from chronofid.plans.roles import TableRoles
from chronofid.session import SEGMENT_CONF, checkpointed

ROLES = TableRoles(key="id", time="t", row="row_ix", num_cols=["a", "b"], cat_cols=["c"])


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key in range(60):
        for t in sorted(rng.choice(20, 15, replace=False)):
            a = None if rng.random() < 0.2 else float(rng.integers(0, 9))
            rows.append((bool(key % 2), None if key == 59 else key // 2, int(t), len(rows), a, float(rng.integers(0, 30)), "xyz"[rng.integers(3)]))
    return spark.createDataFrame(rows, "is_synth boolean, id long, t long, row_ix long, a double, b double, c string").cache()


@pytest.fixture()
def segments(spark):
    def of(rows):
        spark.conf.set(SEGMENT_CONF, str(rows))

    yield of
    spark.conf.unset(SEGMENT_CONF)


@pytest.mark.parametrize("held", [spectra.TERMS_HELD, 1])
def test_short_series_equal_direct_sums(spark, monkeypatch, held):
    monkeypatch.setattr(spectra, "TERMS_HELD", held)
    rng = np.random.default_rng(1)
    rows = [(k, i, None if k == 3 or (k, i) == (5, 2) else float(rng.normal())) for k in range(9) for i in rng.permutation(17).tolist() if (k, i) != (6, 4)]
    rows.append((7, 40, float("nan")))
    df = spark.createDataFrame(rows, "id long, ix long, value double").repartition(3)
    spec = spectra.half_spectrum(df, ["id"], "ix", "value", 17)
    # Values are not copied per frequency.
    assert "explode(sequence" not in spec._jdf.queryExecution().toString()
    freqs = F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))
    direct = spectra.dft(df.withColumn("n", F.lit(17).cast("long")), ["id"], "ix", "value", "n", freqs)
    got, want = ({(r["id"], r["freq"]): r["mag"] for r in x.collect()} for x in (spec, direct))
    assert spec.schema["freq"].dataType == direct.schema["freq"].dataType
    assert len(got) == 81 and got.keys() == want.keys()
    for c in want:
        assert (got[c] is None) == (want[c] is None)
        assert want[c] is None or got[c] == pytest.approx(want[c], abs=1e-12, nan_ok=True)


def test_rays_in_arrays_equal_rows_of_rays(pair, segments, monkeypatch):
    by_rows = []
    monkeypatch.setattr(tr, "sliced_wasserstein", lambda *a: by_rows.append(a) or spectra.sliced_wasserstein(*a))
    run = lambda: {r["feature"]: tuple(r) for r in tr.sliced_tt_wasserstein(pair, ROLES).collect()}
    arrays = run()
    # Up to a segment of entities, no row per entity and ray is made.
    assert not by_rows
    segments(40)
    rows = run()
    assert by_rows
    assert arrays.keys() == rows.keys() == {"*", "a", "b"}
    for f in rows:
        assert arrays[f] == pytest.approx(rows[f], abs=1e-12)
    assert arrays["a"][1] > 0


def test_distances_of_vectors_with_gaps(spark, monkeypatch):
    """Vectors without a known value, without a side, in pieces and with parts missing."""
    monkeypatch.setattr(spectra, "RAYS_GATHERED", 7)
    rng = np.random.default_rng(8)
    rows = [
        (None if k == 20 else bool(k % 2), k, p, d, None if k in (3, 4) and p == "u" else float(rng.normal()))
        for k in range(24) for p, d in (("u", 0), ("u", 1), ("v", 2), ("v", 3)) if (k, p) != (9, "v")
    ]
    rows += [(False, k, "w", 4, 1.0) for k in range(0, 6, 2)]
    vectors = spark.createDataFrame(rows, "is_synth boolean, k long, p string, dim long, x double").repartition(5)
    entity = ["is_synth", "k"]
    parts = spectra.ray_parts(vectors, [*entity, "p"], "dim", "x", 6)
    got = {r["feature"]: r["distance"] for r in spectra.sliced_wasserstein_by_ray(parts, entity, "p").collect()}
    both = spectra.unfolded_rays(parts, [*entity, "p"]).withColumn("feature", F.explode(F.array(F.lit("*"), "p"))).drop("p")
    want = {r["feature"]: r["distance"] for r in spectra.sliced_wasserstein(spectra.projected(both, [*entity, "feature"]), ["feature"]).collect()}
    assert got.keys() == want.keys() == {"*", "u", "v", "w"} and got["w"] is None and want["w"] is None
    assert all(got[f] == pytest.approx(want[f], abs=1e-12) for f in "*uv")


def test_transport_of_ties_and_odd_values():
    assert spectra.transport(np.array([0.0, 1.0, 1.0]), np.array([1.0, 2.0])) == pytest.approx(5 / 6)
    assert spectra.transport(np.array([]), np.array([1.0])) is None
    assert spectra.transport(np.array([np.inf, 1.0]), np.array([1.0, np.inf])) != 0  # zero times infinity is unknown
    assert spectra.transport(np.array([2.0]), np.array([2.0])) == 0


def test_rows_of_a_scan_are_not_written_again(pair, segments, monkeypatch):
    scores = lambda: {tuple(r)[1:3]: r["score"] for r in evaluate(Scan(pair, ROLES), ["trajectories"]).collect()}
    plain = scores()
    segments(400)
    written = []
    monkeypatch.setattr(ordered_module, "checkpointed", lambda df: written.append(df.count()) or checkpointed(df))
    found = scores()
    assert max(written, default=0) < 500
    assert plain.keys() == found.keys() and len(plain) == 8
    assert all(found[c] == pytest.approx(plain[c], abs=1e-12) for c in plain)


def test_a_panel_is_not_dealt_by_side(spark, pair):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = panel.align(pair, ROLES)
        assert "BroadcastHashJoin" in grid._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
