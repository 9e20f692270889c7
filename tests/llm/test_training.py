"""The training of the classifiers against plain loops, and the bounds of their samples."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofid.llm import hashed, mixing, preference, toxicity

from .conftest import sentence


def looped_ftrl(rows, y, size, alpha=1.0, beta=1.0, l1=4.0, l2=1.0, epochs=4, seed=5):
    """FTRL-proximal, one number at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        penalty = 0.0 if i == size else l1
        if abs(z[i]) <= penalty:
            return 0.0
        return -(z[i] - math.copysign(penalty, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            used = [*rows[r], size]
            w = {i: weight(i) for i in used}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y[r]
            for i in used:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_ftrl_equals_a_plain_loop():
    draw = np.random.default_rng(8)
    rows = [np.unique(draw.integers(0, 40, draw.integers(0, 12))).astype(np.int32) for _ in range(300)]
    y = np.array([float(3 in r or 7 in r) for r in rows])
    got = hashed.fit_ftrl(np.arange(40, dtype=np.uint32), rows, y)
    want = looped_ftrl([r.tolist() for r in rows], y, 40)
    assert got.index.tolist() == [i for i, w in enumerate(want[:-1]) if w] and 0 < len(got.index) < 40
    assert np.allclose(got.weight, [w for w in want[:-1] if w]) and got.bias == pytest.approx(want[-1])


def test_margins_equal_a_plain_sum():
    draw = random.Random(2)
    texts = [sentence(draw, n, "ab").split() for n in (0, 1, 2, 3, 4, 30)]
    lists = [[w.encode() for w in t] for t in texts]
    features = [set(np.concatenate([f for _, f in hashed.features([x])]).tolist()) for x in lists]
    known = np.array(sorted(set().union(*features)), np.uint32)[::2]
    model = hashed.Weights(0.25, known, np.linspace(-1, 1, len(known)))
    table = dict(zip(known.tolist(), model.weight))
    want = [0.25 + sum(table.get(f, 0.0) for f in found) for found in features]
    assert np.allclose(hashed.margins(lists, [model], [model.screen()])[:, 0], want)
    # 5 words: themselves, 4 neighbours, 3 pairs that skip one and 2 that skip two.
    assert len(np.concatenate([f for _, f in hashed.features([[b"a", b"b", b"c", b"d", b"e"]])])) == 14


def test_shared_features_equal_counting():
    draw = np.random.default_rng(1)
    rows = [np.unique(draw.choice(np.array([0, 5, 2**28 - 1, 2**28, 2**31, 2**32 - 1], np.uint32), 3)) for _ in range(30)] + [np.zeros(0, np.uint32)]
    known, places = hashed.shared_features(rows, 12)
    times = {f: sum(f in r for r in rows) for f in {int(f) for r in rows for f in r}}
    assert known.tolist() == sorted(f for f, t in times.items() if t >= 12) and 0 < len(known) < 6
    assert [known[p].tolist() for p in places] == [[f for f in r.tolist() if times[f] >= 12] for r in rows]


def test_pair_loss_equals_a_plain_descent():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(120, 2))
    y = (x[:, 0] + 0.3 * draw.normal(size=120) > 0).astype(float)
    model = preference.fit_strength(x, y, pairs=400)
    f = (x[:, model.statistic] > model.limit).astype(float)
    again = np.random.default_rng(3)
    pairs = list(zip(again.choice(np.flatnonzero(y == 1), 400), again.choice(np.flatnonzero(y == 0), 400)))

    def loss(w):
        return sum(math.log1p(math.exp(-float((f[a] - f[b]) @ w))) for a, b in pairs) + 0.5 * float(w @ w)

    def slope(w):
        return sum((-(f[a] - f[b]) / (1 + math.exp(float((f[a] - f[b]) @ w))) for a, b in pairs), w.copy())

    w = np.zeros(f.shape[1])
    for _ in range(3000):
        w -= 0.003 * slope(w)
    assert np.allclose(w, model.weight, atol=2e-2) and loss(model.weight) <= loss(w) + 1e-6
    strength = f @ model.weight
    assert (strength < model.threshold).mean() == pytest.approx((y == 0).mean(), abs=0.05)


def test_quality_learns_from_every_labelled_row(spark):
    """Label 0 stands only at ids that come after 20,000 others in the order of their hashes."""
    ids = spark.range(20_400).select(F.col("id").alias("doc_id"))
    late = {r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()[20_000:]}
    rows = [(i, "JUNK $%& JUNK" if i in late else f"plain words {i}", int(i not in late)) for i in range(20_400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(8)
    model = preference.fit_quality(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    scored = preference.score_quality(frame.select("doc_id", "text"), model).join(frame, "doc_id")
    assert scored.where((F.col("score") >= 0.5).cast("int") != F.col("quality")).count() == 0


def test_pair_sums_equal_a_plain_loop_and_blocks_hold_all_rows(spark, monkeypatch):
    draw = np.random.default_rng(4)
    good, bad, w = draw.integers(0, 2, (5, 4)).astype(float), draw.integers(0, 2, (3, 4)).astype(float), draw.normal(size=4)
    slope, curve = np.zeros(4), np.zeros((4, 4))
    for g in good:
        for b in bad:
            miss = 1 / (1 + math.exp(float((g - b) @ w)))
            slope += (g - b) * miss / 3
            curve += np.outer(g - b, g - b) * miss * (1 - miss) / 3
    found = preference.pair_sums(good, bad, w)
    assert np.allclose(found[0], slope) and np.allclose(found[1], curve)
    monkeypatch.setattr(preference, "BLOCK_ROWS", 4)
    rows = [(1, bytes([i])) for i in range(30)] + [(0, bytes([100 + i])) for i in range(3)] + [(0, bytes([102]))]
    coded = spark.createDataFrame(rows, "label int, code binary")
    blocks = [([bytes(x)[0] for x in r.good], [bytes(x)[0] for x in r.bad]) for r in preference._blocks(coded, {0: 4, 1: 30}).collect()]
    assert sorted(x for g, _ in blocks for x in g) == list(range(30)) and {x for _, b in blocks for x in b} == {100, 101, 102}
    assert len(blocks) == 8 and all(len(g) <= 4 and len(b) == 1 for g, b in blocks)


def test_whole_table_and_arrays_choose_the_same_steps_and_ranks(spark):
    draw = random.Random(5)
    rows = [(i, sentence(draw, draw.randint(1, 40)).upper() if i % 3 == 0 else sentence(draw, draw.randint(1, 40)), int(i % 3 > 0)) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    model = preference.fit_quality(frame.select("doc_id", "text"), frame.select("doc_id", "quality"))
    x, y = np.array([preference.text_statistics(t) for _, t, _ in rows]), np.array([q for _, _, q in rows])
    plain = preference.fit_strength(x, y)
    assert model.statistic.tolist() == plain.statistic.tolist() and model.limit.tolist() == plain.limit.tolist()
    strength = np.sort(model.of(x))
    assert model.threshold == (strength[49] + strength[50]) / 2


def test_sample_by_class_keeps_the_odds_of_the_table(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 50 == 0).cast("int").alias("toxic"))
    picked, added = toxicity.class_sample(labels, "toxic", 200)
    got = {r.label: r["count"] for r in picked.groupBy("label").count().collect()}
    assert got == {0: 150, 1: 50}
    assert math.log(50 / 150) - added == pytest.approx(math.log(100 / 4900))
    whole, added = toxicity.class_sample(labels, "toxic", 6000)
    assert whole.count() == 5000 and added == 0.0
    few, _ = toxicity.class_sample(labels.where("doc_id < 150"), "toxic", 100)
    assert {r.label: r["count"] for r in few.groupBy("label").count().collect()} == {0: 97, 1: 3}


def test_one_row_of_a_repeated_labelled_id(spark):
    draw = random.Random(9)
    rows = [(f"d{i}", sentence(draw, 30) + (" vilebad" if i % 3 == 0 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(60)], "doc_id string, toxic int")
    hot = docs.unionByName(spark.range(10_000).select(F.lit("d1").alias("doc_id"), F.concat(F.lit("vilebad "), (F.col("id") % 500).cast("string")).alias("text")))
    sample = hashed.sampled_features(hot.join(labels.withColumnRenamed("toxic", "label"), "doc_id"), "label")
    assert sample.count() == 60
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(hot, labels)).collect()
    assert all((r.score >= 0.5) == (int(r.doc_id[1:]) % 3 == 0) for r in got)
    domains = labels.select("doc_id", F.when(F.col("toxic") == 1, "a").otherwise("b").alias("domain"))
    assert mixing.mixing_rates(docs, domains, {"a": 0.5, "b": 0.5}).count() == 60


def test_targets_must_weigh_something(spark):
    members = spark.createDataFrame([(1, 5, 0.5, 0.5)], "doc_id long, n_tokens long, p_a double, p_b double")
    for targets in ({"a": 0.0, "b": 0.0}, {"a": 1.0, "b": -0.5}):
        with pytest.raises(ValueError):
            mixing.fit_steps(members, targets)


def test_rates_equal_a_solution_by_multipliers(spark):
    """With all rates above zero, the rates nearest to 1 (weighed by tokens) that meet the targets solve a linear system."""
    draw = np.random.default_rng(6)
    p, n = draw.dirichlet([2.0, 2.0, 2.0], 300), draw.integers(1, 400, 300)
    frame = spark.createDataFrame([(i, int(k), *map(float, x)) for i, (k, x) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p_a double, p_b double, p_c double")
    targets = {"a": 0.36, "b": 0.33, "c": 0.31}
    steps = mixing.fit_steps(frame, targets)
    want = np.array(list(targets.values())) * n.sum()
    kkt = np.block([[np.diag(n.astype(float)), (p * n[:, None])], [(p * n[:, None]).T, np.zeros((3, 3))]])
    exact = np.linalg.solve(kkt, np.concatenate([n.astype(float), want]))[:300]
    assert exact.min() > 0 and np.allclose(mixing.rates_of(p, steps), exact, atol=1e-5)
