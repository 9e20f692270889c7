"""Utility: models trained on one side and judged on the other, and detection of synthetic rows."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.operators.distributions import SYNTH, medians
from chronofid.operators.encode import varying
from chronofid.operators.fill import modes
from chronofid.operators.ordered import ordered
from chronofid.operators.sampling import stratified_folds, stratified_split
from chronofid.plans.roles import union_all
from chronofid.session import checkpointed

TREES = 10
DEPTH = 3


# ---- features -------------------------------------------------------------------------------------


def minimal_features(df: DataFrame, keys: list[str], time: str, cols: list[str]) -> DataFrame:
    """Ten order-free features of every value column per entity, gaps imputed over the entities."""
    known = df.where(F.col(time).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    rows = known.count()
    parts = []
    for c in cols:
        x = F.col(c)
        named = {
            "sum_values": F.sum(x), "mean": F.avg(x), "length": F.count(F.lit(1)).cast("double"),
            "standard_deviation": F.stddev_pop(x), "variance": F.var_pop(x), "root_mean_square": F.sqrt(F.avg(x * x)),
            "maximum": F.max(x), "absolute_maximum": F.max(F.abs(x)), "minimum": F.min(x),
        }
        parts += [f.alias(f"{c}__{n}") for n, f in named.items()]
    features = known.groupBy(*keys).agg(*parts)
    features = features.join(medians(known, keys, {f"{c}__median": c for c in cols}, rows), keys)
    # One row per entity from here on, used by several passes: written once instead of computed anew.
    return impute(checkpointed(features), [c for c in features.columns if c not in keys])


def impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Infinities take the column's finite extreme, nulls its median; a column without values becomes 0."""
    top = float("inf")
    odd = F.lit(False)
    for c in cols:
        odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == top)
    if df.where(odd).isEmpty():
        return df
    finite = {c: F.when(F.abs(c) < top, F.col(c)) for c in cols}
    low, high = (f"_{n}" for n in ("lo", "hi"))
    spans = df.agg(*[f(finite[c]).alias(f"{c}{n}") for c in cols for n, f in ((low, F.min), (high, F.max))])
    clean = df.select(*[finite[c].alias(c) for c in cols])
    middle = medians(clean, [], {f"{c}_mid": c for c in cols}, df.count())
    joined = df.join(F.broadcast(spans), F.lit(True), "left").join(F.broadcast(middle), F.lit(True), "left")

    def value(c: str) -> Column:
        bounded = F.when(F.col(c) == top, F.col(f"{c}{high}")).when(F.col(c) == -top, F.col(f"{c}{low}")).otherwise(F.col(c))
        return F.coalesce(F.when(~F.isnan(bounded), bounded), F.col(f"{c}_mid"), F.lit(0.0))

    helper = [f"{c}{n}" for c in cols for n in (low, high, "_mid")]
    return joined.withColumns({c: value(c) for c in cols}).drop(*helper)


# ---- labels ---------------------------------------------------------------------------------------


def entity_value(df: DataFrame, keys: list[str], value: str, how: str, order: list[str] = ()) -> DataFrame:
    """One value per entity: its mean, its last row's value, or its most frequent value."""
    if how == "mean":
        return df.groupBy(*keys).agg(F.avg(value).alias("value"))
    if how == "last":
        return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("value"))
    if how == "mode":
        return modes(df, keys, value).withColumnRenamed(value, "value")
    raise ValueError(f"how must be mean, last or mode, not {how!r}")


def median_label(values: DataFrame, real: Column) -> DataFrame:
    """1 where the entity's value reaches the median over the real entities."""
    middle = medians(values.where(real), [], {"_m": "value"}, values.count())
    reached = (F.col("value") >= F.col("_m")).cast("int")
    return values.join(F.broadcast(middle), F.lit(True), "left").withColumn("label", F.coalesce(reached, F.lit(0))).drop("_m")


def set_label(values: DataFrame, members: list) -> DataFrame:
    """1 where the entity's value is one of ``members``."""
    return values.withColumn("label", F.coalesce(F.col("value").isin(members).cast("int"), F.lit(0)))


def threshold_label(values: DataFrame, threshold: float) -> DataFrame:
    """1 where the entity's value reaches a fixed threshold."""
    return values.withColumn("label", F.coalesce((F.col("value") >= threshold).cast("int"), F.lit(0)))


# ---- evaluation -----------------------------------------------------------------------------------


def auc(df: DataFrame, keys: list[str], positive: Column, score: str) -> DataFrame:
    """Area under the ROC curve per key by rank sums, ties counting half; null with one class only."""
    sides = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    ranked = ordered(sides, keys, [score]).running(upto="neg").result()
    won = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(won, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def binary_report(
    df: DataFrame, label: str = "label", pred: str = "prediction", score: str = "probability", keys: list[str] = ()
) -> DataFrame:
    """Area under the curve, accuracy, F1, recall and precision of 0/1 predictions, per key."""
    keys = list(keys)
    y, p = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"),
    )
    areas = auc(df, keys, y, score)
    joined = counts.join(areas, keys, "left") if keys else counts.join(F.broadcast(areas), F.lit(True), "left")
    zero = F.lit(0.0)
    return joined.select(
        *keys, "auc", "accuracy",
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero).alias("f1"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero).alias("recall"),
        F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero).alias("precision"),
    )


def multiclass_report(
    df: DataFrame, label: str = "label", pred: str = "prediction", scores: str = "scores", keys: list[str] = ()
) -> DataFrame:
    """Scores weighted by class size, per key. ``scores`` holds one score per class, classes being 0, 1, …"""
    keys = list(keys)
    pairs = df.groupBy(*keys, label, pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)
    actual = pairs.groupBy(*keys, F.col(label).alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    called = pairs.groupBy(*keys, F.col(pred).alias("c")).agg(F.sum("n").alias("called"))
    per_class = actual.join(called, [*keys, "c"], "left").na.fill(0, ["called"])
    long = df.select(*keys, label, F.posexplode(scores).alias("c", "score"))
    areas = auc(long, [*keys, "c"], F.col(label) == F.col("c"), "score")
    per_class = per_class.join(areas, [*keys, "c"], "left")
    zero = F.lit(0.0)
    w = F.col("support")
    total = F.sum(w)

    def weighted(x: Column) -> Column:
        return F.try_divide(F.sum(w * F.coalesce(x, zero)), total)

    return per_class.groupBy(*keys).agg(
        F.when(F.count("auc") > 0, F.try_divide(F.sum(w * F.col("auc")), F.sum(F.when(F.col("auc").isNotNull(), w)))).alias("auc"),
        F.try_divide(F.sum("tp"), total).alias("accuracy"),
        weighted(F.try_divide(2 * F.col("tp"), w + F.col("called"))).alias("f1"),
        weighted(F.try_divide(F.col("tp"), w)).alias("recall"),
        weighted(F.try_divide(F.col("tp"), F.col("called"))).alias("precision"),
    )


def regression_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Mean squared, absolute and relative error, and R squared."""
    off = F.col(label) - F.col(pred)
    tiny = 2.220446049250313e-16
    return df.agg(
        F.avg(off * off).alias("mse"),
        F.avg(F.abs(off)).alias("mae"),
        F.avg(F.abs(off) / F.greatest(F.abs(label), F.lit(tiny))).alias("mape"),
        (1 - F.try_divide(F.avg(off * off), F.var_pop(label))).alias("r2"),
    )


def majority_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Predict the most frequent training label, the smallest on ties."""
    top = modes(train, [], label).select(F.col(label).alias("prediction"))
    joined = test.join(F.broadcast(top), F.lit(True), "left")
    return joined.withColumn("probability", (F.col("prediction") == 1).cast("double"))


def mean_baseline(train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Predict the mean training label."""
    return test.join(F.broadcast(train.agg(F.avg(label).alias("prediction"))), F.lit(True), "left")


def over_seeds(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of each metric over runs."""
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return runs.groupBy(*keys).agg(*stats, F.count(F.lit(1)).alias("runs"))


# ---- models ---------------------------------------------------------------------------------------


def fit_predict(train: DataFrame, test: DataFrame, cols: list[str], label: str, seed: int) -> DataFrame:
    """Gradient-boosted trees; the majority label where features or classes are degenerate."""
    usable = varying(train, cols)
    classes = train.agg((F.min(label) != F.max(label)).alias("two")).first()["two"]
    if not usable or not classes:
        return majority_baseline(train, test, label)
    assembler = VectorAssembler(inputCols=usable, outputCol="features")
    model = GBTClassifier(labelCol=label, featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=seed)
    fitted = model.fit(assembler.transform(train.na.fill(0.0, usable)))
    scored = fitted.transform(assembler.transform(test.na.fill(0.0, usable)))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(*test.columns, "prediction", "probability")


def fit_classes(train: DataFrame, test: DataFrame, cols: list[str], label: str, classes: int, seed: int) -> DataFrame:
    """Trees for each class 0, 1, … against the rest: ``scores`` per class and the class with the best as ``prediction``.

    A class that ``train`` lacks scores 0. The majority class where features or classes are degenerate.
    """
    usable = varying(train, cols)
    present = sorted(r[0] for r in train.select(label).distinct().collect() if r[0] is not None)
    if not usable or len(present) < 2:
        top = majority_baseline(train, test, label).drop("probability")
        return top.withColumn("scores", F.array(*[(F.col("prediction") == c).cast("double") for c in range(classes)]))
    assembler = VectorAssembler(inputCols=usable, outputCol="features")
    ready = assembler.transform(train.na.fill(0.0, usable)).select("features", label)
    ready, scored = checkpointed(ready), assembler.transform(test.na.fill(0.0, usable))
    for c in present:
        learner = GBTClassifier(labelCol="_is", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=seed)
        model = learner.fit(ready.withColumn("_is", (F.col(label) == c).cast("int")))
        score = vector_to_array("probability")[1].alias(f"_score{c}")
        scored = model.transform(scored).select(*scored.columns, score)
    scores = F.array(*[F.col(f"_score{c}") if c in present else F.lit(0.0) for c in range(classes)])
    best = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    return scored.withColumn("scores", scores).withColumn("prediction", best).select(*test.columns, "prediction", "scores")


def fit_number(train: DataFrame, test: DataFrame, cols: list[str], label: str, seed: int) -> DataFrame:
    """Trees for a number; the mean label where features or labels are degenerate."""
    usable = varying(train, cols)
    if not usable or not varying(train, [label]):
        return mean_baseline(train, test, label)
    assembler = VectorAssembler(inputCols=usable, outputCol="features")
    learner = GBTRegressor(labelCol=label, featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=seed)
    model = learner.fit(assembler.transform(train.na.fill(0.0, usable)))
    return model.transform(assembler.transform(test.na.fill(0.0, usable))).select(*test.columns, "prediction")


def train_synthetic_test_real(
    features: DataFrame, labels: DataFrame, ids: list[str], cols: list[str], label: str, seed: int, task: str = "binary", classes: int = 2
) -> DataFrame:
    """Scores on held-out real entities of a model trained on synthetic ones and of one trained on real ones.

    ``features`` and ``labels`` carry ``is_synth``; the test part is a fifth of each real class, or of the real
    entities for the ``task`` ``regression``. Labels of the task ``classes`` are 0 to ``classes`` - 1.
    """
    if task not in ("binary", "classes", "regression"):
        raise ValueError(f"task must be binary, classes or regression, not {task!r}")
    joined = features.join(labels.where(F.col(label).isNotNull()).select(SYNTH, *ids, label), [SYNTH, *ids], "inner")
    joined = checkpointed(joined)
    stratum = F.lit(0) if task == "regression" else F.col(label)
    split = stratified_split(joined.where(~F.col(SYNTH)).withColumn("_stratum", stratum), "_stratum", ids, seed).drop("_stratum")
    real = checkpointed(split)
    test = real.where("is_test").drop("is_test")
    runs = {"synthetic": joined.where(SYNTH), "real": real.where(~F.col("is_test")).drop("is_test")}
    if task == "binary":
        scored = union_all([
            fit_predict(train, test, cols, label, seed).withColumn("train", F.lit(name)) for name, train in runs.items()
        ])
        return binary_report(scored, label, keys=["train"]).withColumn("seed", F.lit(seed))
    reports = []
    for name, train in runs.items():
        if task == "classes":
            report = multiclass_report(checkpointed(fit_classes(train, test, cols, label, classes, seed)), label)
        else:
            report = regression_report(fit_number(train, test, cols, label, seed), label)
        reports.append(report.select(F.lit(name).alias("train"), "*", F.lit(seed).alias("seed")))
    return union_all(reports)


def detection(features: DataFrame, ids: list[str], cols: list[str], seed: int, folds: int = 5) -> DataFrame:
    """Cross-validated scores of telling synthetic from real entities, one row per fold."""
    labelled = features.withColumn("label", F.col(SYNTH).cast("int"))
    placed = checkpointed(stratified_folds(labelled, "label", [SYNTH, *ids], seed, folds))
    scored = union_all([
        fit_predict(placed.where(F.col("fold") != fold), placed.where(F.col("fold") == fold), cols, "label", seed)
        for fold in range(folds)
    ])
    return binary_report(scored, keys=["fold"])


