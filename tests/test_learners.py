"""Learners for classes and numbers, and what they fall back to."""

import random

import pytest
from pyspark.sql import functions as F

from chronofid.plans import repeated as rep
from chronofid.plans import utility as ut


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(1)
    listed = []
    for i in range(240):
        x, y = draw.uniform(0, 9), draw.random()
        listed.append((i, i % 2 == 1, x, y, int(x // 3), 2 * x + 1))
    return spark.createDataFrame(listed, "id long, is_synth boolean, x double, y double, label int, number double")


def test_three_classes_and_a_number(spark, rows):
    features, labels = rows.select("id", "is_synth", "x", "y"), rows.select("id", "is_synth", "label", "number")
    got = {r.train: r for r in ut.train_synthetic_test_real(features, labels, ["id"], ["x", "y"], "label", 3, "classes", 3).collect()}
    assert set(got) == {"synthetic", "real"} and all(r.accuracy > 0.85 and r.auc > 0.9 and r.seed == 3 for r in got.values())
    got = {r.train: r for r in ut.train_synthetic_test_real(features, labels, ["id"], ["x", "y"], "number", 3, "regression").collect()}
    assert set(got) == {"synthetic", "real"} and all(r.r2 > 0.8 for r in got.values())
    with pytest.raises(ValueError):
        ut.train_synthetic_test_real(features, labels, ["id"], ["x"], "label", 3, "ranking")


def test_degenerate_training_sets(spark, rows):
    one = rows.where("label = 1")
    got = ut.fit_classes(one, rows, ["x", "y"], "label", 3, 0).collect()
    assert all(r.prediction == 1 and r.scores == [0.0, 1.0, 0.0] for r in got) and len(got) == 240
    flat = rows.selectExpr("id", "1.0D AS x", "number")
    mean = rows.agg({"number": "avg"}).first()[0]
    assert all(r.prediction == pytest.approx(mean) for r in ut.fit_number(flat, flat, ["x"], "number", 0).collect())
    lacking = ut.fit_classes(rows.where("label <> 2"), rows, ["x", "y"], "label", 3, 0).collect()
    assert all(r.scores[2] == 0.0 and r.prediction in (0, 1) for r in lacking)


def test_runs_of_all_seeds_and_folds(spark, rows):
    apart = rows.withColumn("x", F.when(F.col("is_synth"), F.col("x") + 100).otherwise(F.col("x"))).withColumn("flat", F.lit(3.0))
    runs = rep.detection_runs(apart, ["id"], ["x", "y", "flat"], [4, 5], 3).collect()
    assert {(r.seed, r.fold) for r in runs} == {(s, f) for s in (4, 5) for f in range(3)}
    assert all(r.auc == r.accuracy == 1.0 and r.train_rows == 160 and r.test_rows == 80 and r.features == 2 for r in runs)
    features, labels = rows.select("id", "is_synth", "x", "y"), rows.select("id", "is_synth", "label")
    runs = rep.utility_runs(features, labels, ["id"], ["x", "y"], "label", [1, 2, 3], classes=3)
    assert all(r.accuracy > 0.85 and r.train_rows == 96 and r.test_rows == 24 for r in runs.collect())
    means = ut.over_seeds(runs, ["train"], ["accuracy", "auc"]).collect()
    assert {r.train for r in means} == {"synthetic", "real"} and all(r.runs == 3 and r.accuracy_std is not None for r in means)


def test_runs_with_few_or_no_rows(spark, rows):
    few = rows.where("id < 3").withColumn("x", F.lit(None).cast("double"))
    runs = rep.detection_runs(few, ["id"], ["x"], [1], 2).collect()
    # Rows 0 and 2 are real, row 1 is synthetic: the model that does not see row 1 knows one class only.
    assert {(r.train_rows, r.test_rows, r.features) for r in runs} == {(1, 2, 0), (2, 1, 0)} and all(0 <= r.accuracy <= 1 for r in runs)
    assert rep.detection_runs(rows.where("id < 0"), ["id"], ["x"], [1, 2]).count() == 0


def test_scores_of_trees_for_each_seed(spark, rows):
    features, labels = rows.select("id", "is_synth", "x"), rows.select("id", "is_synth", "number")
    runs = rep.of_each_seed(lambda s: ut.train_synthetic_test_real(features, labels, ["id"], ["x"], "number", s, "regression"), [1, 2])
    assert sorted((r.seed, r.train) for r in runs.collect()) == [(s, t) for s in (1, 2) for t in ("real", "synthetic")]
    assert all(r.runs == 2 and r.r2_mean > 0.8 for r in ut.over_seeds(runs, ["train"], ["r2"]).collect())
