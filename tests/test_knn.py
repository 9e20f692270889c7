"""Pivot-partitioned search against brute force, with copies and a hot key."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from chronofid.operators import knn


def brute(real, synth, k):
    gaps = np.sqrt(((real[:, None, :] - synth[None, :, :]) ** 2).sum(axis=2))
    return np.sort(gaps, axis=1)[:, :k]


def frame(spark, keys, real, synth):
    rows = [(int(k), [float(x) for x in v], False) for k, v in zip(keys[0], real)]
    rows += [(int(k), [float(x) for x in v], True) for k, v in zip(keys[1], synth)]
    return spark.createDataFrame(rows, "day long, vec array<double>, is_synth boolean")


@pytest.mark.parametrize("dims", [1, 3])
@pytest.mark.parametrize("cell_rows", [5000, 20])
def test_keyed_search_is_exact(spark, monkeypatch, dims, cell_rows):
    monkeypatch.setattr(knn, "BLOCK_REAL", 64)
    monkeypatch.setattr(knn, "BLOCK_SYNTH", 16)
    rng = np.random.default_rng(3)
    real, synth = rng.normal(size=(400, dims)), rng.normal(size=(500, dims))
    # Copies: a third of the synthetic rows is one vector, some real rows equal synthetic ones.
    synth[:160] = synth[0]
    real[:20] = synth[200:220]
    keys = (np.where(rng.random(400) < 0.6, 0, rng.integers(1, 8, 400)), np.where(rng.random(500) < 0.6, 0, rng.integers(1, 7, 500)))
    spark.conf.set(knn.CELLS_CONF, str(cell_rows))
    try:
        rows = knn.distances(frame(spark, keys, real, synth), "day", "vec", 2).collect()
    finally:
        spark.conf.unset(knn.CELLS_CONF)
    found = {(r["day"], tuple(r["vec"])): (r["n"], r["best"]) for r in rows}
    for key in np.unique(keys[0]):
        mine, theirs = real[keys[0] == key], synth[keys[1] == key]
        want = brute(mine, theirs, 2) if len(theirs) else np.empty((len(mine), 0))
        for vector, distances in zip(mine, want):
            assert found[(key, tuple(vector))][1] == pytest.approx(list(distances), abs=1e-12)
    assert sum(n for n, _ in found.values()) == len(real)


def test_search_without_key(spark):
    rng = np.random.default_rng(5)
    real, synth = rng.random((300, 4)), rng.random((700, 4))
    spark.conf.set(knn.CELLS_CONF, "50")
    try:
        rows = knn.distances(frame(spark, (np.zeros(300), np.zeros(700)), real, synth), None, "vec", 2).collect()
    finally:
        spark.conf.unset(knn.CELLS_CONF)
    found = {tuple(r["vec"]): r["best"] for r in rows}
    for vector, distances in zip(real, brute(real, synth, 2)):
        assert found[tuple(vector)] == pytest.approx(list(distances), abs=1e-12)


def test_one_synthetic_vector(spark):
    df = frame(spark, (np.zeros(2), np.zeros(1)), np.array([[0.0], [3.0]]), np.array([[1.0]]))
    best = {r["vec"][0]: r["best"] for r in knn.distances(df, None, "vec", 2).collect()}
    assert best == {0.0: [1.0], 3.0: [2.0]}


@pytest.mark.parametrize("spread", [1.0, 1e-4])
def test_trips_are_bounded_in_many_dimensions(spark, monkeypatch, spread):
    """64 dimensions, where hardly any cell can be left out: a vector still travels 1 + NEAR + wards times at most."""
    monkeypatch.setattr(knn, "WARD_ROWS", 1000)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(4, 64))
    draw = lambda n: centres[rng.integers(0, 4, n)] + rng.normal(size=(n, 64)) * spread
    real, synth = draw(300), draw(4000)
    real[0], real[1] = 50.0, synth[7]
    trips, pairs, against, exact = [], [], knn._against, knn._exact
    monkeypatch.setattr(knn, "_against", lambda routed, *rest: trips.append(routed.groupBy("id").count()) or against(routed, *rest))
    monkeypatch.setattr(knn, "_exact", lambda r, s, found, k: pairs.append(found.count()) or exact(r, s, found, k))
    spark.conf.set(knn.CELLS_CONF, "40")
    try:
        rows = knn.distances(frame(spark, (np.zeros(300), np.zeros(4000)), real, synth), None, "vec", 2).collect()
    finally:
        spark.conf.unset(knn.CELLS_CONF)
    found = {tuple(r["vec"]): r["best"] for r in rows}
    for vector, distances in zip(real, brute(real, synth, 2)):
        assert found[tuple(vector)] == pytest.approx(list(distances), rel=1e-9, abs=1e-12)
    most = [t.agg({"count": "max"}).first()[0] or 0 for t in trips]
    assert len(most) == 3 and most[0] == 1 and most[1] <= knn.NEAR and most[2] <= 5
    assert pairs[0] < 40 * len(real)


@pytest.mark.parametrize("dims", [3, 64])
def test_codes_bound_distances_from_both_sides(dims):
    rng = np.random.default_rng(2)
    for size in (1e-9, 1.0, 1e9):
        points = rng.normal(size=(200, dims)) * size + 5 * size
        points[:20] = points[0]
        points[20:40] = points[0] + rng.normal(size=(20, dims)) * size * 1e-6
        centres = points[rng.integers(0, 200, 200)]
        code, scale, rest = knn.encode(points, centres)
        seen = knn.decode(code, scale, centres)
        lower, upper = knn.bounds_between(seen, rest, seen, rest)
        true = np.sqrt(np.square(points[:, None, :] - points[None, :, :]).sum(axis=2))
        assert (lower <= true).all() and (true <= upper).all()
    code, scale, rest = knn.encode(np.array([[np.nan] * dims, [np.inf] * dims, [0.0] * dims]), np.zeros((3, dims)))
    assert list(rest) == [np.inf, np.inf, 0.0] and np.isfinite(knn.decode(code, scale, np.zeros((3, dims)))).all()


@pytest.mark.parametrize("dims", [1, 2, 4])
def test_leaves_find_the_same_as_comparing_all(dims):
    rng = np.random.default_rng(dims)
    synth = np.round(rng.normal(size=(3000, dims)), 2)
    real = np.concatenate([synth[:200], rng.normal(size=(500, dims)), rng.normal(size=(20, dims)) * 100])
    for k in (1, 2, 5):
        assert (knn.nearest(real, synth, k) == knn.smallest_distances(real, synth, k)).all()
    assert knn.nearest(real, synth[:1], 2).shape == (len(real), 1)


def test_boxes_leave_most_vectors_uncompared(spark, monkeypatch):
    """Flat clusters in two dimensions: few rows travel beyond their box, and none to most of the boxes."""
    rng = np.random.default_rng(9)
    real, synth = rng.random((2000, 2)) * [1000, 1], rng.random((6000, 2)) * [1000, 1]
    real[:50] += 5000
    routed, blocks = [], knn._blocks
    monkeypatch.setattr(knn, "_blocks", lambda rows, *rest: routed.append(rows.count()) or blocks(rows, *rest))
    monkeypatch.setattr(knn, "_by_codes", None)
    spark.conf.set(knn.CELLS_CONF, "200")
    try:
        rows = knn.distances(frame(spark, (np.zeros(2000), np.zeros(6000)), real, synth), "day", "vec", 2).collect()
    finally:
        spark.conf.unset(knn.CELLS_CONF)
    found = {tuple(r["vec"]): r["best"] for r in rows}
    for vector, distances in zip(real, brute(real, synth, 2)):
        assert found[tuple(vector)] == pytest.approx(list(distances), abs=1e-12)
    assert routed[0] == 2000 and sum(routed[1:]) < 4000


def test_infinite_vectors_beside_boxes(spark):
    rng = np.random.default_rng(4)
    real, synth = rng.normal(size=(60, 2)), rng.normal(size=(90, 2))
    real[0, 0], synth[3, 1] = np.inf, -np.inf
    keys = (np.arange(60) % 2, np.where(np.arange(90) < 2, 1, 0))
    synth[0] = [np.inf, 0.0]
    spark.conf.set(knn.CELLS_CONF, "20")
    try:
        rows = knn.distances(frame(spark, keys, real, synth), "day", "vec", 2).collect()
    finally:
        spark.conf.unset(knn.CELLS_CONF)
    found = {(r["day"], tuple(r["vec"])): r["best"] for r in rows}
    assert len(found) == 60 and found[0, tuple(real[0])] == [np.inf, np.inf]
    for i in range(1, 60):
        want = brute(real[i : i + 1], synth[keys[1] == i % 2], 2)[0]
        assert found[i % 2, tuple(real[i])] == pytest.approx(list(want), abs=1e-12)


def test_a_block_holds_small_tables_of_distances():
    rng = np.random.default_rng(2)

    def side(n):
        code, scale, rest = knn.encode(rng.normal(size=(n, 16)), np.zeros((n, 16)))
        return pd.DataFrame({"key": "", "cell": 0, "id": np.arange(n), "code": code, "scale": scale, "rest": rest, "bound": np.inf})

    real, synth = side(1024), side(8192)
    block = knn._candidates(1, SimpleNamespace(value={}), 16)
    tracemalloc.start()
    try:
        found = block(real, synth)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found["id"].nunique() == len(real)
    assert peak < 32 << 20


def test_rows_meet_many_pivots_in_small_tables():
    rows = pd.DataFrame({"key": "", "id": np.arange(10_000)})
    pieces = list(knn._slices([rows], {"": np.zeros((200, 16))}))
    assert sum(len(p) for _, p, _ in pieces) == len(rows)
    assert max(len(p) for _, p, _ in pieces) * 200 * 8 <= 4 << 20
