"""Column roles of one sequence table and the shape of score output."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.functions.times import seconds
from chronofid.operators.distributions import SYNTH

SCORES = (
    "dataset string, model string, variant string, family string, metric string, "
    "table string, feature string, score double, detail map<string,double>"
)


@dataclass(frozen=True)
class TableRoles:
    """What each column of a sequence table means.

    ``row`` is the order the rows had in their source; it breaks ties wherever order matters.
    """

    key: str
    time: str
    row: str = "row_ix"
    num_cols: list[str] = field(default_factory=list)
    cat_cols: list[str] = field(default_factory=list)
    periodicity: str | None = None
    representation: str | None = None
    independence: str = "independent"

    def with_time(self, time: str) -> TableRoles:
        return replace(self, time=time)


def pair_of(real: DataFrame, synth: DataFrame) -> DataFrame:
    """Stack both sides into one frame, told apart by ``is_synth``."""
    labelled = real.withColumn(SYNTH, F.lit(False))
    return labelled.unionByName(synth.withColumn(SYNTH, F.lit(True)), allowMissingColumns=True)


def numeric_time(pair: DataFrame, roles: TableRoles) -> DataFrame:
    """Replace the time column by seconds (timestamps) or doubles (relative numbers)."""
    kind = pair.schema[roles.time].dataType.typeName()
    value = seconds(roles.time) if kind.startswith("timestamp") or kind == "date" else F.col(roles.time).cast("double")
    return pair.withColumn(roles.time, value)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def named(df: DataFrame, metric: str, score: str | Column = "score", feature: str | Column = "*") -> DataFrame:
    """Keep ``(metric, feature, score)`` of a score frame."""
    feature = F.lit(feature) if isinstance(feature, str) else feature
    score = F.col(score) if isinstance(score, str) else score
    return df.select(F.lit(metric).alias("metric"), feature.alias("feature"), score.cast("double").alias("score"))


def summary(scores: DataFrame) -> DataFrame:
    """Mean over features per metric; null scores do not count."""
    return scores.groupBy("metric").agg(F.avg("score").alias("score"))


def labelled(scores: DataFrame, dataset: str, model: str, variant: str, family: str, table: str) -> DataFrame:
    """Bring a suite's output to the long score schema."""
    detail = F.col("detail") if "detail" in scores.columns else F.lit(None)
    return scores.select(
        F.lit(dataset).alias("dataset"),
        F.lit(model).alias("model"),
        F.lit(variant).alias("variant"),
        F.lit(family).alias("family"),
        "metric",
        F.lit(table).alias("table"),
        "feature",
        F.when(~F.isnan("score"), F.col("score")).alias("score"),
        detail.cast("map<string,double>").alias("detail"),
    )
