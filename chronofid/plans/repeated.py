"""Utility and detection over several seeds and folds, all models fitted in the same job from shared features.

The learner is Gaussian naive Bayes. What a model needs is the number, sum, sum of squares and extremes of each feature
within each class of its training rows. These are counted once for every part (a fold, a held-out or a training part) of
every seed; a model adds up the parts that it may see. Features are read and shuffled once, whatever the number of models;
only ids, labels and part numbers are copied per seed. A table of models has one row per seed and part.

Trees cannot be added up that way: ``of_each_seed`` runs any one-seed score of ``utility`` for several seeds side by side.

Features are used around their mean in units of their deviation, nulls reading 0 as for trees. ``SMOOTHING`` is added to each
variance, so a feature that is constant in a class still has a density, and one that is constant in both decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH
from chronofid.operators.sampling import seeded_positions
from chronofid.plans.roles import union_all
from chronofid.plans.utility import binary_report, multiclass_report
from chronofid.session import checkpointed

SMOOTHING = 1e-3
METRICS = ["auc", "accuracy", "f1", "recall", "precision"]
_SUMS = {"s": F.sum, "q": F.sum, "lo": F.min, "hi": F.max}


def scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """``cols`` around their mean in units of their deviation; a constant column becomes 0."""
    whole = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    stats = whole.agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("d", F.stddev_pop))])
    joined = whole.join(F.broadcast(stats), F.lit(True), "left")
    zs = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.nullif(F.col(f"d_{c}"), F.lit(0.0))), F.lit(0.0)) for c in cols}
    return joined.withColumns(zs).select(*df.columns)


def part_sums(rows: DataFrame, part: list[str], label: str, cols: list[str]) -> DataFrame:
    """``part, label, _n`` and per feature its sum, sum of squares and extremes."""
    sums = [F.sum(c).alias(f"s_{c}") for c in cols] + [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in cols]
    ends = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    return rows.groupBy(*part, label).agg(F.count(F.lit(1)).alias("_n"), *sums, *ends)


def models(parts: DataFrame, keys: list[str], label: str, cols: list[str], classes: int) -> DataFrame:
    """``keys, train_rows, features`` and per class ``n_k`` and an array of ``(mean, var)``, from the parts a model may see."""
    added = [F.sum("_n").alias("_n"), *[f(f"{n}_{c}").alias(f"{n}_{c}") for c in cols for n, f in _SUMS.items()]]
    seen = parts.groupBy(*keys, label).agg(*added)
    mean = {c: F.col(f"s_{c}") / F.col("_n") for c in cols}
    shapes = [F.struct(mean[c].alias("mean"), (F.greatest(F.col(f"q_{c}") / F.col("_n") - mean[c] * mean[c], F.lit(0.0)) + SMOOTHING).alias("var")) for c in cols]
    shaped = seen.withColumn("_shape", F.array(*shapes))
    varying = [(F.min(f"lo_{c}") < F.max(f"hi_{c}")).cast("long") for c in cols]
    of_class = [f for k in range(classes) for f in (
        F.coalesce(F.max(F.when(F.col(label) == k, F.col("_n"))), F.lit(0)).alias(f"n_{k}"),
        F.max(F.when(F.col(label) == k, F.col("_shape"))).alias(f"shape_{k}"),
    )]
    count = sum(varying[1:], varying[0]) if varying else F.lit(0).cast("long")
    return shaped.groupBy(*keys).agg(F.sum("_n").alias("train_rows"), count.alias("features"), *of_class)


def _log_weight(k: int, cols: list[str]) -> Column:
    """Log of the class share times its density; null for a class without training rows."""
    total = F.log(F.col(f"n_{k}").cast("double"))
    for i, c in enumerate(cols):
        mean, var = F.col(f"shape_{k}")[i]["mean"], F.col(f"shape_{k}")[i]["var"]
        total = total - (F.col(c) - mean) * (F.col(c) - mean) / (2 * var) - F.log(var) / 2
    return F.when(F.col(f"n_{k}") > 0, total)


def scored(rows: DataFrame, fitted: DataFrame, keys: list[str], cols: list[str], classes: int, keep: list[str]) -> DataFrame:
    """``keep`` with ``weights`` (per class, rounded so that summation order does not decide ties) and the ``prediction``.

    A class that the training rows lack weighs less than any other; equal weights go to the smaller class.
    """
    joined = rows.join(F.broadcast(fitted), keys)
    weights = F.array(*[F.coalesce(F.round(_log_weight(k, cols), 6), F.lit(float("-inf"))) for k in range(classes)])
    weighed = joined.select(*keep, weights.alias("weights"))
    return weighed.withColumn("prediction", (F.array_position("weights", F.array_max("weights")) - 1).cast("int"))


def _reports(found: DataFrame, label: str, keys: list[str], classes: int) -> DataFrame:
    if classes > 2:
        return multiclass_report(found.withColumnRenamed("weights", "scores"), label, keys=keys)
    # With one class in training the difference is infinite: equal for all rows, as it should be.
    odds = found.withColumn("probability", F.col("weights")[1] - F.col("weights")[0])
    return binary_report(odds, label, keys=keys)


def detection_runs(features: DataFrame, ids: list[str], cols: list[str], seeds: Iterable[int], folds: int = 5) -> DataFrame:
    """``seed, fold, train_rows, test_rows, features`` and scores of telling synthetic from real entities.

    Each fold is judged by a model of the seed's other folds. ``features`` carries ``is_synth``.
    """
    labelled = checkpointed(scaled(features.withColumn("label", F.col(SYNTH).cast("int")), cols).select(SYNTH, *ids, "label", *cols))
    places = seeded_positions(labelled, "label", [SYNTH, *ids], seeds)
    rows = labelled.join(places.select("seed", SYNTH, *ids, (F.col("_pos") % folds).cast("int").alias("fold")), [SYNTH, *ids])
    parts = checkpointed(part_sums(rows, ["seed", "fold"], "label", cols))
    own = parts.select("seed", F.col("fold").alias("_own")).distinct()
    others = parts.join(F.broadcast(own), "seed").where(F.col("_own") != F.col("fold")).drop("fold").withColumnRenamed("_own", "fold")
    fitted = checkpointed(models(others, ["seed", "fold"], "label", cols, 2))
    found = scored(rows, fitted, ["seed", "fold"], cols, 2, ["seed", "fold", "label"])
    sizes = parts.groupBy("seed", "fold").agg(F.sum("_n").alias("test_rows"))
    report = _reports(checkpointed(found), "label", ["seed", "fold"], 2)
    return report.join(sizes, ["seed", "fold"]).join(fitted.select("seed", "fold", "train_rows", "features"), ["seed", "fold"])


def utility_runs(
    features: DataFrame, labels: DataFrame, ids: list[str], cols: list[str], label: str, seeds: Iterable[int],
    test_ratio: float = 0.2, classes: int = 2,
) -> DataFrame:
    """``train, seed, train_rows, test_rows, features`` and scores on held-out real entities.

    For each seed the same share of every class and side is held out. The models learn from the rest of the synthetic
    side (``train`` reads ``synthetic``) and from the rest of the real side (``real``); both are judged by what the real
    side holds out. Labels are 0 to ``classes`` - 1; ``features`` and ``labels`` carry ``is_synth``.
    """
    known = labels.where(F.col(label).isNotNull()).select(SYNTH, *ids, F.col(label).alias("label"))
    labelled = checkpointed(scaled(features.join(known, [SYNTH, *ids]), cols).select(SYNTH, *ids, "label", *cols))
    stratum = labelled.select(F.struct(SYNTH, "label").alias("_stratum"), SYNTH, *ids)
    places = seeded_positions(stratum, "_stratum", [SYNTH, *ids], seeds)
    held = (F.col("_pos") < F.rint(F.col("_size") * test_ratio)).alias("held")
    rows = labelled.join(places.select("seed", SYNTH, *ids, held), [SYNTH, *ids])
    rows = rows.withColumn("train", F.when(F.col(SYNTH), "synthetic").otherwise("real"))
    parts = part_sums(rows.where(~F.col("held")), ["seed", "train"], "label", cols)
    fitted = checkpointed(models(parts, ["seed", "train"], "label", cols, classes))
    test = rows.where(F.col("held") & ~F.col(SYNTH)).drop("train")
    found = checkpointed(scored(test, fitted, ["seed"], cols, classes, ["train", "seed", "label"]))
    sizes = found.groupBy("train", "seed").agg(F.count(F.lit(1)).alias("test_rows"))
    report = _reports(found, "label", ["train", "seed"], classes)
    return report.join(sizes, ["train", "seed"]).join(fitted.select("train", "seed", "train_rows", "features"), ["train", "seed"])


def of_each_seed(run: Callable[[int], DataFrame], seeds: Iterable[int], side_by_side: int = 2) -> DataFrame:
    """Rows of ``run(seed)`` for all seeds, with ``seed``; as many as ``side_by_side`` are fitted at a time."""
    seeds = list(seeds)

    def one(seed: int) -> DataFrame:
        return checkpointed(run(seed).withColumn("seed", F.lit(seed)))

    with ThreadPool(side_by_side) as pool:
        return union_all(pool.map(inheritable_thread_target(SparkSession.active())(one), seeds))


def averaged_folds(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean over the folds of a seed; a null score does not count."""
    return runs.groupBy(*keys, "seed").agg(*[F.avg(m).alias(m) for m in metrics])
