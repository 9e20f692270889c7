"""Features, labels, models and their evaluation over ``events`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, Catalogue, ctes, events, table
from chronofid.operators.encode import varying
from chronofid.plans import repeated as rep
from chronofid.plans import utility as ut

CATALOGUE = Catalogue()
add = CATALOGUE.add

ENTITY = ["is_synth", "user_id"]
COLS = ["value", "k"]
STATS = ["sum_values", "mean", "length", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum", "median"]
FEATURES = [f"{c}__{s}" for c in COLS for s in STATS]
SEED = 7

_FEATURE_SQL = {
    "sum_values": "sum({c})", "mean": "avg({c})", "length": "CAST(count(*) AS DOUBLE)", "standard_deviation": "stddev_pop({c})",
    "variance": "var_pop({c})", "root_mean_square": "sqrt(avg({c} * {c}))", "maximum": "max({c})",
    "absolute_maximum": "max(abs({c}))", "minimum": "min({c})", "median": "median({c})",
}
FEAT = "feat AS (SELECT syn AS is_synth, user_id, " + ", ".join(
    f"{_FEATURE_SQL[s].format(c=c)} AS {c}__{s}" for c in COLS for s in STATS) + " FROM ev GROUP BY 1, 2)"


def features(spark, folder):
    return ut.minimal_features(events(spark, folder), ENTITY, "ts", COLS)


def labels(spark, folder):
    values = ut.entity_value(events(spark, folder), ENTITY, "value", "mean")
    return ut.median_label(values, ~F.col("is_synth")).select(*ENTITY, "label")


def _cols(prefix=""):
    return ", ".join(f"round({prefix}{f}, 6) AS {f}" for f in FEATURES)


@add("agg5_minimal_features", ctes(EV, FEAT) + f"SELECT is_synth, user_id, {_cols()} FROM feat")
def agg5(spark, folder):
    return features(spark, folder)


@add("u1_label_mean_median", ctes(EV) + """, v AS (SELECT syn AS is_synth, user_id, avg(value) AS value FROM ev GROUP BY 1, 2)
SELECT is_synth, user_id, round(value, 6) AS value, CAST(value >= (SELECT median(value) FROM v WHERE NOT is_synth) AS INTEGER) AS label FROM v""")
def u1_mean(spark, folder):
    return ut.median_label(ut.entity_value(events(spark, folder), ENTITY, "value", "mean"), ~F.col("is_synth"))


@add("u1_label_last_threshold", ctes(EV) + """, v AS (SELECT syn AS is_synth, user_id, arg_max(value, t * 1000000 + event_id / 100000000.0) AS value FROM ev GROUP BY 1, 2)
SELECT is_synth, user_id, round(value, 6) AS value, CAST(value >= 50 AS INTEGER) AS label FROM v""")
def u1_last(spark, folder):
    return ut.threshold_label(ut.entity_value(events(spark, folder), ENTITY, "value", "last", ["ts", "event_id"]), 50.0)


@add("u1_label_mode_in_set", ctes(EV) + """, c AS (SELECT syn, user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2, 3),
v AS (SELECT syn AS is_synth, user_id, event_type AS value, row_number() OVER (PARTITION BY syn, user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT is_synth, user_id, value, CAST(value IN ('click', 'purchase') AS INTEGER) AS label FROM v WHERE rn = 1""")
def u1_mode(spark, folder):
    return ut.set_label(ut.entity_value(events(spark, folder), ENTITY, "event_type", "mode"), ["click", "purchase"])


@add("win10_last_row", """SELECT o_custkey, round(o_totalprice, 6) AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) q WHERE rn = 1""")
def win10(spark, folder):
    return ut.entity_value(table(spark, folder, "orders"), ["o_custkey"], "o_totalprice", "last", ["o_orderdate", "o_orderkey"])


@add("u2_train_synthetic_test_real")
def u2(spark, folder):
    return ut.train_synthetic_test_real(features(spark, folder), labels(spark, folder), ["user_id"], FEATURES, "label", SEED)


def level(value):
    """Three classes of an entity's mean value."""
    return F.when(value < 40, 0).when(value < 55, 1).otherwise(2)


@add("u2_train_synthetic_test_real_classes")
def u2_classes(spark, folder):
    values = ut.entity_value(events(spark, folder), ENTITY, "value", "mean")
    labelled = values.select(*ENTITY, level(F.col("value")).alias("label"))
    return ut.train_synthetic_test_real(features(spark, folder), labelled, ["user_id"], FEATURES, "label", SEED, "classes", 3)


@add("u2_train_synthetic_test_real_regression")
def u2_regression(spark, folder):
    values = ut.entity_value(events(spark, folder), ENTITY, "value", "last", ["ts", "event_id"])
    labelled = values.select(*ENTITY, F.col("value").alias("label"))
    return ut.train_synthetic_test_real(features(spark, folder), labelled, ["user_id"], FEATURES, "label", SEED, "regression")


@add("u3_detection")
def u3(spark, folder):
    return ut.detection(features(spark, folder), ["user_id"], FEATURES, SEED)


PRED = """p AS (SELECT quality AS label, CAST(n_chars > 500 AS INTEGER) AS prediction, n_chars AS s FROM documents JOIN labels USING (doc_id))"""


def predictions(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "n_chars").join(table(spark, folder, "labels"), "doc_id")
    return joined.select(
        F.col("quality").alias("label"), (F.col("n_chars") > 500).cast("int").alias("prediction"), F.col("n_chars").alias("probability")
    )


AUC = """(SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) FROM p a, p b WHERE a.label = 1 AND b.label <> 1)"""


@add("u4_binary_report", ctes(PRED) + f"""
SELECT round({AUC}, 6) AS auc, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy,
  round(2.0 * count(*) FILTER (label = 1 AND prediction = 1) / (count(*) FILTER (label = 1) + count(*) FILTER (prediction = 1)), 6) AS f1,
  round(1.0 * count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (label = 1), 6) AS recall,
  round(1.0 * count(*) FILTER (label = 1 AND prediction = 1) / count(*) FILTER (prediction = 1), 6) AS precision FROM p""")
def u4_binary(spark, folder):
    return ut.binary_report(predictions(spark, folder))


MULTI = """p AS (SELECT label, list_position(embedding, list_max(embedding)) - 1 AS prediction, embedding AS s FROM embeddings),
k AS (SELECT DISTINCT label AS c FROM p),
area AS (SELECT c, sum(CASE WHEN a.s[c + 1] > b.s[c + 1] THEN 1.0 WHEN a.s[c + 1] = b.s[c + 1] THEN 0.5 ELSE 0 END) / count(*) AS auc
  FROM k, p a, p b WHERE a.label = c AND b.label <> c GROUP BY 1),
cls AS (SELECT c, count(*) FILTER (label = c) AS n, count(*) FILTER (prediction = c) AS called, count(*) FILTER (label = c AND prediction = c) AS tp FROM k, p GROUP BY 1)"""


@add("u4_multiclass_report", ctes(MULTI) + """
SELECT round(sum(n * auc) / sum(n), 6) AS auc, round(CAST(sum(tp) AS DOUBLE) / sum(n), 6) AS accuracy, round(sum(n * 2.0 * tp / (n + called)) / sum(n), 6) AS f1,
  round(sum(n * 1.0 * tp / n) / sum(n), 6) AS recall, round(sum(CASE WHEN called > 0 THEN n * 1.0 * tp / called ELSE 0 END) / sum(n), 6) AS precision FROM cls JOIN area USING (c)""")
def u4_multi(spark, folder):
    best = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    df = table(spark, folder, "embeddings").select("label", best.alias("prediction"), F.col("embedding").alias("scores"))
    return ut.multiclass_report(df)


@add("u4_regression_report", """
WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS f FROM lineitem)
SELECT round(avg((y - f) * (y - f)), 2) AS mse, round(avg(abs(y - f)), 6) AS mae, round(avg(abs(y - f) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape,
  round(1 - avg((y - f) * (y - f)) / var_pop(y), 6) AS r2 FROM p""")
def u4_regression(spark, folder):
    df = table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction")
    )
    return ut.regression_report(df).withColumn("mse", F.round("mse", 2))


@add("u5_majority_baseline", ctes(EV, FEAT) + """, v AS (SELECT syn, user_id, event_type AS label FROM ev),
top AS (SELECT label AS prediction FROM v WHERE syn GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT prediction, CAST(0 AS DOUBLE) AS probability, round(avg(CAST(label = prediction AS DOUBLE)), 6) AS accuracy FROM v, top WHERE NOT syn GROUP BY 1""")
def u5_majority(spark, folder):
    df = events(spark, folder).select("is_synth", F.col("event_type").alias("label"))
    scored = ut.majority_baseline(df.where("is_synth").select("label"), df.where("not is_synth").select("label"))
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return scored.groupBy("prediction").agg(F.lit(0.0).alias("probability"), F.avg(hit).alias("accuracy"))


@add("u5_mean_baseline", ctes(EV) + """
SELECT round(avg((value - m) * (value - m)), 6) AS mse, round(avg(abs(value - m)), 6) AS mae
FROM ev, (SELECT avg(value) AS m FROM ev WHERE syn) q WHERE NOT syn""")
def u5_mean(spark, folder):
    df = events(spark, folder).select("is_synth", F.col("value").alias("label"))
    scored = ut.mean_baseline(df.where("is_synth").select("label"), df.where("not is_synth").select("label"))
    return ut.regression_report(scored).select("mse", "mae")


@add("u6_over_seeds", """
WITH r AS (SELECT l_returnflag AS method, l_linenumber AS seed, avg(l_quantity) AS a, avg(l_discount) AS b FROM lineitem GROUP BY 1, 2)
SELECT method, round(avg(a), 6) AS a_mean, round(stddev_samp(a), 6) AS a_std, round(avg(b), 6) AS b_mean, round(stddev_samp(b), 6) AS b_std, count(*) AS runs FROM r GROUP BY 1""")
def u6(spark, folder):
    runs = table(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("method"), "l_linenumber").agg(
        F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b")
    )
    return ut.over_seeds(runs, ["method"], ["a", "b"])


SEEDS = [1, 2, 3]
RUN_METRICS = [*rep.METRICS, "train_rows", "test_rows", "features"]
#: Scaled features in long form; ``SHAPES`` takes the training rows of every model from ``seen``.
LONG = f"""lng AS (UNPIVOT (SELECT is_synth, user_id, {", ".join(f"coalesce({f}, 0) AS {f}" for f in FEATURES)} FROM feat) ON {", ".join(FEATURES)} INTO NAME f VALUE x),
zs AS (SELECT is_synth, user_id, f, coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0) AS z FROM lng WINDOW w AS (PARTITION BY f)),
sd AS (SELECT unnest({SEEDS}) AS seed)"""


def _runs_sql(keys: str, classes: int) -> str:
    """CTEs from ``seen`` (training rows per model, with ``y``) and ``judged`` (rows to score, with ``y``) to ``r``, one row per model."""
    return f"""shp AS (SELECT {keys}, y, f, count(*) AS n, avg(z) AS m, var_pop(z) + {rep.SMOOTHING} AS v, min(z) AS lo, max(z) AS hi FROM seen JOIN zs USING (is_synth, user_id) GROUP BY ALL),
wt AS (SELECT {keys}, is_synth, user_id, judged.y, shp.y AS c, round(ln(max(n)) - sum((z - m) * (z - m) / (2 * v) + ln(v) / 2), 6) AS w
  FROM judged JOIN zs USING (is_synth, user_id) JOIN shp USING ({keys}, f) GROUP BY ALL),
pr AS (SELECT {keys}, is_synth, user_id, y, arg_max(c, w * 1000000 - c / 10.0) AS p, {", ".join(f"max(w) FILTER (c = {k}) AS w{k}" for k in range(classes))} FROM wt GROUP BY ALL),
cl AS (SELECT unnest(range({classes})) AS c),
sc AS (SELECT {keys}, y, p, c, CASE c {" ".join(f"WHEN {k} THEN w{k}" + (f" - w{1 - k}" if classes == 2 else "") for k in range(classes))} END AS s FROM pr, cl),
ar AS (SELECT {keys}, c, sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) / count(*) AS auc
  FROM sc a JOIN sc b USING ({keys}, c) WHERE a.y = c AND b.y <> c GROUP BY ALL),
pc AS (SELECT {keys}, c, count(*) FILTER (y = c) AS sup, count(*) FILTER (p = c) AS called, count(*) FILTER (y = c AND p = c) AS tp, count(*) AS test_rows FROM sc GROUP BY ALL),
vary AS (SELECT {keys}, count(*) AS features FROM (SELECT {keys}, f FROM shp GROUP BY ALL HAVING min(lo) < max(hi)) q GROUP BY ALL),
tr AS (SELECT {keys}, count(*) AS train_rows FROM seen GROUP BY ALL)"""


BINARY_RUNS = """SELECT {keys}, auc, (pc.tp + test_rows - sup - called + pc.tp) / test_rows::DOUBLE AS accuracy, coalesce(2.0 * tp / nullif(sup + called, 0), 0) AS f1,
  coalesce(1.0 * tp / nullif(sup, 0), 0) AS recall, coalesce(1.0 * tp / nullif(called, 0), 0) AS precision, train_rows, test_rows, features
  FROM pc LEFT JOIN ar USING ({keys}, c) JOIN tr USING ({keys}) JOIN vary USING ({keys}) WHERE c = 1"""
CLASS_RUNS = """SELECT {keys}, sum(sup * auc) / sum(sup) FILTER (auc IS NOT NULL) AS auc, sum(tp) / sum(sup)::DOUBLE AS accuracy, sum(sup * 2.0 * tp / (sup + called)) / sum(sup) AS f1,
  sum(tp) / sum(sup)::DOUBLE AS recall, sum(CASE WHEN called > 0 THEN sup * 1.0 * tp / called ELSE 0 END) / sum(sup) AS precision, max(train_rows) AS train_rows, max(test_rows) AS test_rows, max(features) AS features
  FROM pc LEFT JOIN ar USING ({keys}, c) JOIN tr USING ({keys}) JOIN vary USING ({keys}) WHERE sup > 0 GROUP BY ALL"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std" for m in RUN_METRICS)
FOLDS_SQL = """pl AS (SELECT seed, is_synth, user_id, CAST(is_synth AS INTEGER) AS y,
  (row_number() OVER (PARTITION BY seed, is_synth ORDER BY md5(seed || ':' || is_synth || ':' || user_id), is_synth, user_id) - 1) % 5 AS fold FROM feat, sd),
judged AS (SELECT * FROM pl),
seen AS (SELECT t.seed, t.fold, r.is_synth, r.user_id, r.y FROM (SELECT DISTINCT seed, fold FROM pl) t JOIN pl r ON r.seed = t.seed AND r.fold <> t.fold)"""
HELD_SQL = """pl AS (SELECT seed, is_synth, user_id, y, row_number() OVER (PARTITION BY seed, is_synth, y ORDER BY md5(seed || ':' || is_synth || ':' || user_id), is_synth, user_id) - 1
  < round_even(count(*) OVER (PARTITION BY seed, is_synth, y) * 0.2, 0) AS held FROM lb, sd),
seen AS (SELECT seed, CASE WHEN is_synth THEN 'synthetic' ELSE 'real' END AS train, is_synth, user_id, y FROM pl WHERE NOT held),
judged AS (SELECT seed, train, is_synth, user_id, y FROM pl, (SELECT DISTINCT train FROM seen) t WHERE held AND NOT is_synth)"""


@add("u3_detection_over_seeds", ctes(EV, FEAT, LONG, FOLDS_SQL, _runs_sql("seed, fold", 2), f"r AS ({BINARY_RUNS.format(keys='seed, fold')})") + f"""
SELECT {_MEANS}, count(*) AS runs FROM (SELECT seed, {", ".join(f"avg({m}) AS {m}" for m in RUN_METRICS)} FROM r GROUP BY 1) q""")
def u3_seeds(spark, folder):
    runs = rep.detection_runs(features(spark, folder), ["user_id"], FEATURES, SEEDS)
    return ut.over_seeds(rep.averaged_folds(runs, [], RUN_METRICS), [], RUN_METRICS)


@add("u2_utility_over_seeds", ctes(EV, FEAT, LONG, """v AS (SELECT syn AS is_synth, user_id, avg(value) AS value FROM ev GROUP BY 1, 2),
lb AS (SELECT is_synth, user_id, CAST(value >= (SELECT median(value) FROM v WHERE NOT is_synth) AS INTEGER) AS y FROM v)""",
    HELD_SQL, _runs_sql("seed, train", 2), f"r AS ({BINARY_RUNS.format(keys='seed, train')})") + f"SELECT train, {_MEANS}, count(*) AS runs FROM r GROUP BY 1")
def u2_seeds(spark, folder):
    runs = rep.utility_runs(features(spark, folder), labels(spark, folder), ["user_id"], FEATURES, "label", SEEDS)
    return ut.over_seeds(runs, ["train"], RUN_METRICS)


@add("u2_utility_over_seeds_classes", ctes(EV, FEAT, LONG, """v AS (SELECT syn AS is_synth, user_id, avg(value) AS value FROM ev GROUP BY 1, 2),
lb AS (SELECT is_synth, user_id, CASE WHEN value < 40 THEN 0 WHEN value < 55 THEN 1 ELSE 2 END AS y FROM v)""",
    HELD_SQL, _runs_sql("seed, train", 3), f"r AS ({CLASS_RUNS.format(keys='seed, train')})") + f"SELECT train, {_MEANS}, count(*) AS runs FROM r GROUP BY 1")
def u2_seeds_classes(spark, folder):
    values = ut.entity_value(events(spark, folder), ENTITY, "value", "mean")
    labelled = values.select(*ENTITY, level(F.col("value")).alias("label"))
    runs = rep.utility_runs(features(spark, folder), labelled, ["user_id"], FEATURES, "label", SEEDS, classes=3)
    return ut.over_seeds(runs, ["train"], RUN_METRICS)


@add("fil6_varying_features", """
WITH d AS (SELECT *, 1 AS constant FROM customer)
SELECT 'c_custkey' AS feature FROM d HAVING count(DISTINCT c_custkey) > 1 UNION ALL SELECT 'c_acctbal' FROM d HAVING count(DISTINCT c_acctbal) > 1
UNION ALL SELECT 'constant' FROM d HAVING count(DISTINCT constant) > 1""")
def fil6(spark, folder):
    df = table(spark, folder, "customer").withColumn("constant", F.lit(1))
    return spark.createDataFrame([(c,) for c in varying(df, ["c_custkey", "c_acctbal", "constant"])], "feature string")
