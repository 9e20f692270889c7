"""Edge cases of the scores on tiny frames, and properties every similarity must have."""

import pytest
from pyspark.sql import functions as F

from chronofid.plans import columns, privacy, sections, structure, timestamps, trajectories
from chronofid.plans import panel
from chronofid.plans.roles import TableRoles, pair_of

ROLES = TableRoles(key="k", time="t", row="row_ix", num_cols=["x", "y"], cat_cols=["c", "d"])
SCHEMA = "k long, t double, x double, y double, c string, d string, row_ix long"


def side(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def pair(spark, real, synth):
    return pair_of(side(spark, real), side(spark, synth))


def row(k, t, x=0.0, y=0.0, c="a", d="b"):
    return (k, None if t is None else float(t), x, y, c, d)


def only(df):
    return df.first()["score"]


@pytest.fixture(scope="module")
def sample(spark):
    rows = [row(k, t, float((k * 7 + t * 3) % 11), float((k * 5 + t * t) % 7), "abc"[(k + t) % 3], "uv"[t % 2]) for k in range(6) for t in range(9)]
    return side(spark, rows).cache()


def test_real_against_itself_scores_one(sample):
    both = pair_of(sample, sample)
    frames = [
        columns.suite(both, ROLES.num_cols, ROLES.cat_cols, [("k", "x")]),
        sections.suite(both, ROLES),
        trajectories.suite(both, ROLES, 2).where("metric <> 'SlicedTTWasserstein'"),
        timestamps.suite(both, ROLES).where("score is not null"),
        structure.length_similarity(both, ROLES).select(F.lit("length").alias("metric"), F.lit("*").alias("feature"), "score"),
    ]
    for df in frames:
        scores = {(r["metric"], r["feature"]): r["score"] for r in df.collect()}
        assert scores and all(v == pytest.approx(1.0) for v in scores.values()), scores


def test_distance_to_itself_is_zero(sample):
    both = pair_of(sample, sample)
    assert all(r["distance"] == pytest.approx(0.0) for r in trajectories.sliced_tt_wasserstein(both, ROLES).collect())
    assert privacy.closest_record(privacy.with_vector(both, ["x", "y"])).first()["mean"] == 0.0


def test_contributions_sum_to_one(spark, sample):
    other = sample.withColumn("x", F.col("x") * F.col("t")).withColumn("y", F.col("y") + F.col("k"))
    parts = trajectories.sliced_tt_wasserstein(pair_of(sample, other), ROLES).where("feature <> '*'").collect()
    assert sum(r["contribution"] for r in parts) == pytest.approx(1.0) and {r["rank"] for r in parts} == {1, 2}


def test_row_order_does_not_matter(sample):
    shuffled = sample.orderBy(F.xxhash64("row_ix"))
    a = columns.suite(pair_of(sample, sample), ROLES.num_cols, ROLES.cat_cols)
    b = columns.suite(pair_of(shuffled, sample), ROLES.num_cols, ROLES.cat_cols)
    left, right = ({tuple(r)[:2]: r["score"] for r in df.collect()} for df in (a, b))
    assert left == pytest.approx(right)


def test_timestamp_scores_without_pairs(spark):
    lonely = pair(spark, [row(1, 0), row(2, 5)], [row(1, 3)])
    assert only(timestamps.order_consistency(lonely, ROLES)) == 1.0
    assert only(timestamps.uniqueness(lonely, ROLES)) == 1.0
    assert only(timestamps.regularity(lonely, ROLES, 1.0)) == 0.0
    assert only(timestamps.interval_similarity(lonely, ROLES)) == 0.0


def test_file_order_counts_reversals(spark):
    df = pair(spark, [row(1, 0)], [row(1, 2), row(1, 1), row(1, 1), row(1, 5)])
    assert only(timestamps.order_consistency(df, ROLES)) == pytest.approx(2 / 3)
    assert only(timestamps.uniqueness(df, ROLES)) == pytest.approx(2 / 3)


def test_range_compliance(spark):
    df = pair(spark, [row(1, 0), row(1, 10)], [row(1, -1), row(1, 5), row(2, 0), row(2, 11), row(3, None)])
    assert only(timestamps.range_compliance(df, ROLES, "Absolute")) == pytest.approx(2 / 5)
    # Relative: -1 is out of range and off origin but counts once; 11 and the null are out of range.
    assert only(timestamps.range_compliance(df, ROLES, "Relative")) == pytest.approx(2 / 5)
    # A start just below zero is out of range, but near enough to the origin; it takes nothing from the late one.
    near = pair(spark, [row(1, 0), row(1, 5)], [row(1, -1e-9), row(2, 3)])
    assert only(timestamps.range_compliance(near, ROLES, "Relative")) == pytest.approx(0.0)
    late = pair(spark, [row(1, 0), row(1, 10)], [row(1, 2), row(1, 5)])
    assert only(timestamps.range_compliance(late, ROLES, "Relative")) == pytest.approx(1 / 2)


def test_grid_completeness_closes_real_gaps(spark):
    # The real trajectory has positions 0, 1, 5: three positions in a row from 0.
    df = pair(spark, [row(1, 0), row(1, 10), row(1, 50)], [row(7, 0), row(7, 20), row(8, 0)])
    got = timestamps.grid_completeness(df, ROLES, 10.0).first()
    assert (got["score"], got["support_coverage"]) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert got["multiplicity_preservation"] == 1.0


def test_periodicity(spark):
    even = pair(spark, [row(1, t) for t in range(5)], [row(1, 0)])
    assert tuple(timestamps.periodicity(even, ROLES).first()) == ("Regular", 1.0)
    same = pair(spark, [row(1, 3), row(1, 3)], [row(1, 0)])
    assert tuple(timestamps.periodicity(same, ROLES).first()) == ("Irregular", None)


def test_constant_columns(spark):
    df = pair(spark, [row(1, t, 1.0, float(t)) for t in range(4)], [row(1, t, float(t), float(t)) for t in range(4)])
    # An undefined correlation counts as zero: |0 - 1| / 2.
    assert only(columns.correlation_similarity(df, ["x", "y"])) == pytest.approx(0.5)
    assert sections.correlation_similarity(df, ROLES).count() == 0
    flat = pair(spark, [row(1, t, float(t)) for t in range(4)], [row(1, t, float(t + 7)) for t in range(3)])
    scores = {r["feature"]: r["score"] for r in trajectories.first_difference_ks(flat, ROLES).collect()}
    assert scores == {"x": 1.0, "y": 1.0}


def test_too_few_differences(spark):
    df = pair(spark, [row(1, 0), row(1, 1)], [row(1, 0), row(1, 1), row(1, 2)])
    assert [r["score"] for r in trajectories.first_difference_ks(df, ROLES).collect()] == [None, None]


def test_null_categories(spark):
    real = [row(1, t, c=c) for t, c in enumerate(["a", None, "a", "b"])]
    df = pair(spark, real, [row(1, t, c="a") for t in range(4)])
    assert {r["feature"]: r["score"] for r in columns.tv_complement(df, ["c"]).collect()}["c"] == pytest.approx(2 / 3)
    assert only(columns.contingency_similarity(df, ["c", "d"])) == pytest.approx(0.5)


def test_absent_section_scores_zero_coverage(spark):
    df = pair(spark, [row(1, 0, c="a"), row(1, 1, c="b")], [row(1, 0, c="a")])
    got = {r["feature"]: r["score"] for r in sections.category_coverage(df, ROLES).collect()}
    assert got["c"] == pytest.approx(0.5)
    assert {r["feature"]: r["score"] for r in sections.tv_complement(df, ROLES).collect()}["c"] == 1.0


def test_transitions_need_neighbouring_times(spark):
    real = [row(1, 0, c="a"), row(1, 1, c="b"), row(1, 2, c="a")]
    skipping = [row(1, 0, c="a"), row(1, 2, c="b")]
    assert trajectories.transition_similarity(pair(spark, real, skipping), ROLES).count() == 0
    other = [row(1, 0, c="a"), row(1, 1, c="a"), row(1, 2, c="a")]
    # At time 0 the tables differ by 2 over 2 * 2; at time 1 no synthetic row leaves b, which adds 2.
    got = {r["feature"]: r["score"] for r in trajectories.transition_similarity(pair(spark, real, other), ROLES).collect()}
    assert got["c"] == pytest.approx(0.5)


def test_sequence_lengths(spark):
    df = pair(spark, [row(1, 0), row(2, 0)], [row(1, 0), row(1, 1)])
    assert structure.length_similarity(df, ROLES).first()["score"] == 0.0
    assert structure.length_similarity(df, ROLES, strict=True).first()["score"] is None
    keyless = pair(spark, [row(None, 0), row(1, 0)], [row(1, 0)])
    assert structure.length_similarity(keyless, ROLES).first()["real_flows"] == 2


def test_edge_fill_keeps_inner_gaps(spark):
    real = [row(1, t, float(t)) for t in range(5)]
    synth = [row(5, 1, 10.0), row(5, 3, 30.0)]
    grid = panel.align(pair(spark, real, synth), ROLES, "edge_nearest").where("is_synth").orderBy("time_ix")
    assert [r["x"] for r in grid.collect()] == [10.0, 10.0, 0.0, 30.0, 30.0]
    # A repeated cell makes the inner gap take the last value, and the first of the copies counts.
    twice = [*synth, row(5, 1, 99.0)]
    grid = panel.align(pair(spark, real, twice), ROLES, "edge_nearest").where("is_synth").orderBy("time_ix")
    assert [r["x"] for r in grid.collect()] == [10.0, 10.0, 10.0, 30.0, 30.0]


def test_ngrams_of_short_trajectories(spark):
    real = [row(1, 0, 1.0), row(1, 1, 2.0), row(2, 0, 3.0)]
    synth = [row(1, 0, 3.0), row(2, 0, 1.0), row(2, 1, 2.0), row(3, 0, 1.0)]
    df = pair(spark, real, synth)
    # With n=3 every trajectory is one whole run: (3), (1,2) match, (1) does not.
    got = privacy.ngram_exposure(df, ROLES, 3).first()
    assert (got["matched_total"], got["ngrams_total"], got["score"]) == (2, 3, pytest.approx(2 / 3))


def test_neighbour_ratio_excludes_zero_distances(spark):
    df = privacy.with_vector(pair(spark, [row(1, 0, 1.0), row(1, 1, 5.0)], [row(1, 0, 1.0), row(1, 1, 1.0), row(1, 2, 4.0)]), ["x"])
    got = privacy.neighbour_ratio(df).first()
    assert (got["n_excluded"], got["median"]) == (1, pytest.approx(0.25))
