"""Storing scores, reading score files of other runs, and rolling both up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Score names per family, in report order.
FAMILIES = {
    "timestamp": [
        "TemporalOrderConsistency", "TimestampUniqueness", "TrajectoryDurationSimilarity", "TemporalRangeCompliance",
        "RegularityConsistency", "GridCompleteness", "TimeIntervalDistributionSim",
    ],
    "sd": [
        "KSComplement", "TVComplement", "StatisticSimilarity", "CorrelationSim", "RangeCoverage", "CategoryCoverage",
        "ContingencySim", "StatisticMSAS",
    ],
    "cross_sectional": [
        "CS-KSComplement", "CS-TVComplement", "CS-StatisticSimilarity", "CS-CorrelationSim", "CS-RangeCoverage",
        "CS-CategoryCoverage", "CS-ContingencySim",
    ],
    "structural": [
        "SequenceLengthSimilarity", "TemporalCardinalityShapeSimilarity", "DynamicKHopCorrelationSimilarity",
    ],
    "longitudinal": [
        "FirstDifferenceKSComplement", "TransitionMatrixTVDComplement", "AutoCorrelationSimilarity", "SlicedTTWasserstein",
    ],
    "privacy": ["dcr", "nndr", "cs_dcr", "cs_nndr", "ngram_n1", "ngram_n3"],
}
# Prefixes under which structural scores may be stored.
STRUCTURAL_PREFIXES = {
    "sequence_length_similarity": "SequenceLengthSimilarity",
    "temporal_cardinality_shape_similarity": "TemporalCardinalityShapeSimilarity",
    "dynamic_khop": "DynamicKHopCorrelationSimilarity",
}
# Variants a file name may end with, and the variant each family is averaged over.
VARIANTS = ["interp_fill", "prev_fill", "id_fill", "default", "raw"]
FAMILY_VARIANT = {
    "timestamp": "raw", "sd": "default", "cross_sectional": "default", "structural": "default",
    "longitudinal": "interp_fill", "privacy": "default",
}
# Scores that describe the table before any repair, and former names of scores.
RAW_STRUCTURAL = ["SequenceLengthSimilarity", "TemporalCardinalityShapeSimilarity"]
OLD_NAMES = {"TransitionMatrixSimilarity": "TransitionMatrixTVDComplement", "temporal_dcr": "cs_dcr", "temporal_nndr": "cs_nndr"}


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append to the long score table, NaN as null, one folder per dataset and family."""
    clean = scores.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
    clean.write.mode("append").partitionBy("dataset", "family").format(fmt).save(path)


def write_score_file(bodies: DataFrame, folder: str) -> None:
    """Add a JSON file with the one row of ``bodies`` (``summary``, ``per_metric``, ``details``) to ``folder``."""
    bodies.coalesce(1).write.mode("append").json(folder)


def canonical_metric(metric: str) -> Column:
    """Current score name of an older or prefixed one."""
    name = F.col(metric)
    lower = F.lower(F.trim(name))
    result = name
    for old, new in OLD_NAMES.items():
        result = F.when(name == old, F.lit(new)).otherwise(result)
    for prefix, family in STRUCTURAL_PREFIXES.items():
        stored = (lower == prefix) | lower.startswith(f"{prefix}_") | name.startswith(f"{family}_")
        result = F.when(stored, F.lit(family)).otherwise(result)
    return result


def read_score_files(spark: SparkSession, root: str) -> DataFrame:
    """Scores from JSON files ``root/dataset/model/family/file.json``.

    A file holds a ``summary`` of scores. Structural scores may also stand under ``per_metric`` (numbers, or objects of
    them), which goes before the summary, or under ``details`` (objects with a ``score``), which do so if nothing
    structural stands under ``per_metric``. The variant is the end of the file name. Several files of one variant
    are averaged.
    """
    schema = "summary map<string,double>, per_metric map<string,string>, details map<string,string>"
    raw = spark.read.schema(schema).json(f"{root}/*/*/*/*.json", multiLine=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")
    ending = F.regexp_extract(stem, f"(?:^|_)({'|'.join(VARIANTS)})$", 1)
    family = F.element_at(parts, -2)
    files = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.element_at(parts, -4).alias("dataset"),
        F.element_at(parts, -3).alias("model"),
        F.when(ending != "", ending).when(family == "timestamp", "raw").otherwise("default").alias("variant"),
        F.when(family == "trajectory_privacy", "privacy").otherwise(family).alias("family"),
        "summary", "per_metric", "details",
    )
    place = ["file", "dataset", "model", "variant", "family"]
    structural = lambda name: canonical_metric(name).isin(list(STRUCTURAL_PREFIXES.values()))
    summed = files.select(*place, F.lit("summary").alias("part"), F.explode("summary").alias("stored", "score"))
    per_metric = files.select(*place, F.explode("per_metric").alias("parent", "text"))
    numbers = F.coalesce(F.from_json("text", "map<string,double>"), F.create_map("parent", F.col("text").try_cast("double")))
    children = per_metric.select(*place, "parent", F.explode(numbers).alias("child", "score"))
    named = children.select(*place, F.lit("per_metric").alias("part"), F.when(structural("child"), F.col("child")).otherwise(F.col("parent")).alias("stored"), "score")
    detailed = files.select(*place, F.lit("details").alias("part"), F.explode("details").alias("stored", "text")).select(
        *place, "part", "stored", F.get_json_object("text", "$.score").try_cast("double").alias("score")
    )
    rows = summed.unionByName(named.where(structural("stored"))).unionByName(detailed.where(structural("stored")))
    valid = rows.withColumn("metric", canonical_metric("stored")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    mean = lambda part: F.avg(F.when(F.col("part") == part, F.col("score"))).alias(part)
    each = valid.groupBy(*place, "metric").agg(*map(mean, ("summary", "per_metric", "details")))
    # A file has a handful of metrics.
    has_per_metric = F.count("per_metric").over(Window.partitionBy("file")) > 0
    chosen = each.withColumn("score", F.coalesce("per_metric", F.when(~has_per_metric, F.col("details")), "summary")).where("score IS NOT NULL")
    return chosen.groupBy("dataset", "model", "variant", "family", "metric").agg(F.avg("score").alias("score"))


def metric_names() -> list[str]:
    return [m for metrics in FAMILIES.values() for m in metrics]


def by_variant(scores: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per dataset, model and variant, one column per metric."""
    names = metric_names() if metrics is None else metrics
    means = scores.groupBy("dataset", "model", "variant", "metric").agg(F.avg("score").alias("score"))
    return means.groupBy("dataset", "model", "variant").pivot("metric", names).agg(F.first("score"))


def by_family(scores: DataFrame, families: list[str] | None = None) -> DataFrame:
    """One row per dataset and model: mean score per family over its own variant; nulls do not count."""
    wanted = F.coalesce(*[F.when(F.col("family") == f, v) for f, v in FAMILY_VARIANT.items()])
    # Lengths and cardinalities describe the table as generated, before any repair.
    wanted = F.when(F.col("metric").isin(RAW_STRUCTURAL), F.lit("raw")).otherwise(wanted)
    chosen = scores.where(F.col("variant") == wanted)
    means = chosen.groupBy("dataset", "model", "family", "metric").agg(F.avg("score").alias("score"))
    names = list(FAMILIES) if families is None else families
    return means.groupBy("dataset", "model").pivot("family", names).agg(F.avg("score"))
