"""The registry of metrics and the scan they share, and long indicators."""

import pytest
from pyspark.sql import functions as F

from chronofid.operators import encode
from chronofid.plans import columns, metrics, sections, timestamps  # noqa: F401
from chronofid.plans.metrics import Scan, evaluate, metric
from chronofid.plans.roles import TableRoles, pair_of

ROLES = TableRoles(key="k", time="t", row="row_ix", num_cols=["x"], cat_cols=["c"])


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    rows = [(k, t, k * 10 + t, float(k * t % 5), "ab"[t % 2], "unused") for k in range(4) for t in range(6)]
    side = spark.createDataFrame(rows, "k long, t long, row_ix long, x double, c string, extra string")
    path = str(tmp_path_factory.mktemp("pair"))
    pair_of(side, side.withColumn("x", F.col("x") + 1)).write.parquet(path, mode="overwrite")
    return path


def test_source_is_read_once_and_only_the_columns_of_the_roles(spark, source):
    scan = Scan(spark.read.parquet(source), ROLES)
    found = evaluate(scan, ["static", "sections", "timestamps"])
    assert not any(source in f for f in found.inputFiles()) and "extra" not in scan.pair.columns
    kept = dict(scan._kept)
    scores = {(r.family, r.metric, r.feature): r.score for r in found.collect()}
    assert scores["static", "TVComplement", "c"] == 1.0 and scores["static", "RangeCoverage", "x"] < 1.0
    assert scores["timestamps", "TimestampUniqueness", "*"] == 1.0 and ("static", "CorrelationSim", "x x c") not in scores
    evaluate(scan, ["static"])
    assert scan._kept == kept


def test_suites_agree_with_single_scores(spark, source):
    pair = spark.read.parquet(source)
    got = {r.metric: r.score for r in columns.suite(pair, ["x"], ["c"]).collect()}
    for name, score in {"KSComplement": columns.ks_complement, "StatisticSimilarity": columns.statistic_similarity, "RangeCoverage": columns.range_coverage}.items():
        assert got[name] == pytest.approx(score(pair, ["x"]).first().score)
    assert got["TVComplement"] == columns.tv_complement(pair, ["c"]).first().score
    assert got["CategoryCoverage"] == columns.category_coverage(pair, ["c"]).first().score


def test_a_metric_of_ones_own(spark, source):
    @metric("own", "Rows", applies=lambda scan: scan.options.get("count", True))
    def rows(scan):
        return scan.pair.agg(F.count(F.lit(1)).alias("score"))

    try:
        pair = spark.read.parquet(source)
        assert [tuple(r) for r in evaluate(Scan(pair, ROLES), ["own"]).collect()] == [("own", "Rows", "*", 48.0)]
        assert evaluate(Scan(pair, ROLES, {"count": False}), ["own"]).collect() == []
    finally:
        metrics.forget("own", "Rows")
    assert evaluate(Scan(pair, ROLES), ["own"]).count() == 0


def test_long_indicators_of_many_categories(spark):
    df = spark.range(100_000).select("id", F.concat(F.lit("c"), "id").alias("c"), F.when(F.col("id") % 2 == 0, "x").alias("d"))
    with pytest.raises(ValueError):
        encode.expand_categories(df, df, ["c"])
    got = encode.sparse_indicators(df, df.where("id < 99990"), ["id"], ["c", "d"])
    assert got.count() == 200_000 and got.where("column = 'c'").agg(F.countDistinct("category_id")).first()[0] == 99_991
    assert got.where("category_id = -1").count() == 10 and {tuple(r) for r in got.where("column = 'd'").select("category_id", "indicator").distinct().collect()} == {(0, 1.0), (1, 1.0)}
    nothing = df.where("id < 0")
    assert encode.sparse_indicators(nothing, df, ["id"], ["c"]).count() == 0
    assert encode.sparse_indicators(df.where("id < 3"), nothing, ["id"], ["d"]).where("category_id = -1").count() == 3
