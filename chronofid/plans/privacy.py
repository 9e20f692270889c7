"""Privacy: how close synthetic rows and row sequences come to real ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.functions.labels import right_closed_bin, token
from chronofid.functions.numeric import to_double
from chronofid.functions.times import day_of
from chronofid.operators import knn
from chronofid.operators.distributions import SYNTH, medians, weighted_medians
from chronofid.operators.ordered import ordered
from chronofid.operators.shape import distinct_counts
from chronofid.plans.roles import TableRoles, union_all

ZERO = 1e-12
BINS = 10


def with_vector(pair: DataFrame, cols: list[str]) -> DataFrame:
    """Adds ``vec`` of the numeric columns; rows with a missing one are dropped."""
    complete = pair.withColumns({c: to_double(c) for c in cols}).dropna("any", subset=cols)
    return complete.withColumn("vec", F.array(*cols))


def whole_days(pair: DataFrame, time: str) -> DataFrame:
    """Timestamps cut to the day; other times unchanged."""
    if pair.schema[time].dataType.typeName().startswith("timestamp"):
        return pair.withColumn(time, day_of(time))
    return pair


def closest_record(pair: DataFrame, vector: str = "vec", found: DataFrame | None = None) -> DataFrame:
    """Distance of each real row to its closest synthetic row: median and mean.

    ``found`` may hold distances already computed for the same rows.
    """
    found = knn.distances(pair, None, vector, 1) if found is None else found
    known = found.withColumn("d", F.try_element_at("best", F.lit(1))).where(F.col("d").isNotNull())
    known = known.select("d", "n")
    rows = pair.count()
    stats = known.agg(
        F.try_divide(F.sum(F.col("d") * F.col("n")), F.sum("n")).alias("mean"), F.sum("n").alias("n_rows")
    )
    return weighted_medians(known, [], "d", "n", rows).join(F.broadcast(stats), F.lit(True), "left")


def _ratios(found: DataFrame) -> DataFrame:
    """Ratio of the two smallest distances, rows with a second neighbour only; null where that is zero."""
    two = found.where(F.size("best") >= 2)
    d1, d2 = F.element_at("best", 1), F.element_at("best", 2)
    return two.withColumn("ratio", F.when(d2 > ZERO, F.try_divide(d1, d2)))


def neighbour_ratio(pair: DataFrame, vector: str = "vec", found: DataFrame | None = None) -> DataFrame:
    """Ratio of first to second neighbour distance: median, mean, range and excluded rows."""
    found = knn.distances(pair, None, vector, 2) if found is None else found
    ratios = _ratios(found).select("ratio", "n")
    known = F.col("ratio").isNotNull()
    stats = ratios.agg(
        F.try_divide(F.sum(F.col("ratio") * F.col("n")), F.sum(F.when(known, F.col("n")))).alias("mean"),
        F.min("ratio").alias("min"),
        F.max("ratio").alias("max"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_excluded"),
    )
    return weighted_medians(ratios, [], "ratio", "n", pair.count()).join(F.broadcast(stats), F.lit(True), "left")


def _over_times(per_time: DataFrame, rows: int) -> DataFrame:
    mean = per_time.agg(F.avg("median").alias("mean_over_time"), F.count("median").alias("n_times"))
    middle = medians(per_time, [], {"median_over_time": "median"}, rows)
    return mean.join(F.broadcast(middle), F.lit(True), "left")


def sectional_closest_record(
    pair: DataFrame, roles: TableRoles, vector: str = "vec", found: DataFrame | None = None
) -> DataFrame:
    """Median closest-record distance per shared timestamp, averaged over time."""
    found = knn.distances(whole_days(pair, roles.time), roles.time, vector, 1) if found is None else found
    known = found.withColumn("d", F.try_element_at("best", F.lit(1))).where(F.col("d").isNotNull())
    rows = pair.count()
    return _over_times(weighted_medians(known, [roles.time], "d", "n", rows), rows)


def sectional_neighbour_ratio(
    pair: DataFrame, roles: TableRoles, vector: str = "vec", found: DataFrame | None = None
) -> DataFrame:
    """Median neighbour ratio per timestamp with two or more synthetic rows, averaged over time."""
    found = knn.distances(whole_days(pair, roles.time), roles.time, vector, 2) if found is None else found
    ratios = _ratios(found)
    rows = pair.count()
    return _over_times(weighted_medians(ratios, [roles.time], "ratio", "n", rows), rows)


def bin_edges(real: DataFrame, cols: list[str], bins: int = BINS) -> dict[str, list[float]]:
    """Inner edges of equal-width bins over the real range; columns with few values are left out."""
    distinct = distinct_counts(real, cols)
    wide = [c for c in cols if distinct[c] > bins]
    if not wide:
        return {}
    row = real.agg(*[f(c).alias(f"{n}|{c}") for c in wide for n, f in (("lo", F.min), ("hi", F.max))]).first()
    spans = {c: (float(row[f"lo|{c}"]), float(row[f"hi|{c}"])) for c in wide}
    return {c: [lo + i * (hi - lo) / bins for i in range(1, bins)] for c, (lo, hi) in spans.items()}


def known_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with at least one feature."""
    return df.dropna("all", subset=cols)


def row_token(roles: TableRoles, edges: dict[str, list[float]]) -> Column:
    """The row's features as an array of tokens, binned where bins were fitted."""
    parts = [token(right_closed_bin(c, edges[c])) if c in edges else token(c) for c in roles.num_cols]
    return F.array(*parts, *[F.coalesce(F.col(c).cast("string"), F.lit("__NA__")) for c in roles.cat_cols])


def ngrams(pair: DataFrame, roles: TableRoles, n: int, edges: dict[str, list[float]]) -> DataFrame:
    """Runs of ``n`` consecutive row tokens; a shorter trajectory gives one run of its whole length."""
    rows = pair.where(F.col(roles.key).isNotNull()).select(
        SYNTH, roles.key, roles.time, roles.row, row_token(roles, edges).alias("_g0")
    )
    out = ordered(rows, [SYNTH, roles.key], [roles.time, roles.row], pair.count()).numbered("_pos")
    for i in range(1, n):
        out = out.lead(**{f"_g{i}": f"_g{i - 1}"})
    names = [f"_g{i}" for i in range(n)]
    kept = out.result().where(F.col(names[-1]).isNotNull() | (F.col("_pos") == 0))
    return kept.select(SYNTH, roles.key, F.filter(F.array(*names), lambda g: g.isNotNull()).alias("gram"))


def exposures(pair: DataFrame, roles: TableRoles, n: int = 3, bins: int = BINS) -> DataFrame:
    """Per synthetic entity: its n-grams and how many of them occur on the real side."""
    cols = [*roles.num_cols, *roles.cat_cols]
    present = known_rows(pair, cols)
    edges = bin_edges(present.where(~F.col(SYNTH)), roles.num_cols, bins)
    grams = ngrams(present, roles, n, edges)
    real = grams.where(~F.col(SYNTH)).select("gram").distinct().withColumn("_real", F.lit(True))
    # Equal grams of an entity are counted before the join, so a frequent one is matched once per entity.
    synth = grams.where(SYNTH).groupBy(roles.key, "gram").agg(F.count(F.lit(1)).alias("n"))
    joined = synth.join(real, "gram", "left")
    return joined.groupBy(roles.key).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("_real"), F.col("n")).otherwise(0)).alias("matched")
    )


def ngram_exposure(pair: DataFrame, roles: TableRoles, n: int = 3, bins: int = BINS) -> DataFrame:
    """Mean, overall and median share of synthetic n-grams that occur on the real side."""
    share = exposures(pair, roles, n, bins).withColumn("share", F.col("matched") / F.col("total"))
    stats = share.agg(
        F.avg("share").alias("score"),
        F.try_divide(F.sum("matched"), F.sum("total")).alias("micro_score"),
        F.count("share").alias("n_entities"),
        F.sum("matched").alias("matched_total"),
        F.sum("total").alias("ngrams_total"),
    )
    middle = medians(share, [], {"median_exposure": "share"}, pair.count())
    return stats.join(F.broadcast(middle), F.lit(True), "left")


def suite(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """All privacy scores of one table; ``feature`` names the statistic."""
    vectors = with_vector(pair, roles.num_cols)
    # One search for two neighbours serves both the distance and the ratio.
    near = knn.distances(vectors, None, "vec", 2)
    near_by_time = knn.distances(whole_days(vectors, roles.time), roles.time, "vec", 2)

    def rows(df: DataFrame, metric: str, stats: list[str]) -> DataFrame:
        long = df.select(*[F.col(s).cast("double").alias(s) for s in stats]).unpivot([], stats, "feature", "score")
        return long.select(F.lit(metric).alias("metric"), "feature", "score")

    return union_all([
        rows(closest_record(vectors, found=near), "DCR", ["median", "mean"]),
        rows(neighbour_ratio(vectors, found=near), "NNDR", ["median", "mean", "min", "max"]),
        rows(sectional_closest_record(vectors, roles, found=near_by_time), "CS-DCR", ["mean_over_time", "median_over_time"]),
        rows(sectional_neighbour_ratio(vectors, roles, found=near_by_time), "CS-NNDR", ["mean_over_time", "median_over_time"]),
        rows(ngram_exposure(pair, roles, 1), "NGramExposure-1", ["score", "micro_score", "median_exposure"]),
        rows(ngram_exposure(pair, roles, 3), "NGramExposure-3", ["score", "micro_score", "median_exposure"]),
    ])
