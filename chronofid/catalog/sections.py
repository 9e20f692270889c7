"""Cross-sectional scores over ``events`` by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, Catalogue, ctes, daily_events, ks_cte, table, tvd_cte
from chronofid.catalog.columns import corr_sql, pairs_sql
from chronofid.plans import sections as cs
from chronofid.plans.roles import TableRoles
from chronofid.functions.labels import align_labels

CATALOGUE = Catalogue()
add = CATALOGUE.add

ROLES = TableRoles(key="user_id", time="ts", row="event_id", num_cols=["value", "k"], cat_cols=["event_type", "band"])

DAYS = """d AS (SELECT *, CASE WHEN value < 20 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END AS band FROM ev)"""
NUM = "num AS (SELECT syn, day, 'value' AS feature, value FROM d UNION ALL SELECT syn, day, 'k', k FROM d)"
CAT = "cat AS (SELECT syn, day, 'event_type' AS feature, event_type AS value FROM d UNION ALL SELECT syn, day, 'band', band FROM d)"
KS = ks_cte("ks", "num", "feature, day", "value")
TV = tvd_cte("tv", "cat", "feature, day", "value")
STAT = """st AS (SELECT feature, day, syn, avg(value) AS mean, median(value) AS median, stddev_pop(value) AS std
  FROM num WHERE value IS NOT NULL GROUP BY 1, 2, 3),
tall AS (SELECT feature, day, syn, 'mean' AS stat, mean AS v FROM st UNION ALL SELECT feature, day, syn, 'median', median FROM st
  UNION ALL SELECT feature, day, syn, 'std', std FROM st),
sides AS (SELECT feature, stat, day, max(v) FILTER (NOT syn) AS r, max(v) FILTER (syn) AS s FROM tall GROUP BY 1, 2, 3),
spread AS (SELECT feature, stat, max(r) - min(r) AS w FROM sides GROUP BY 1, 2),
per AS (SELECT feature, stat, avg(greatest(0, least(1, 1 - abs(r - s) / (w + 1e-10)))) AS score
  FROM sides JOIN spread USING (feature, stat) WHERE r IS NOT NULL AND s IS NOT NULL GROUP BY 1, 2)"""
NP = pairs_sql("np", [("value", "k")], "d", "day, ")
RHO = corr_sql("rho", "np", "feature, day")
BOUNDS = """bounds AS (SELECT feature, day, min(value) AS lo, max(value) AS hi FROM num WHERE NOT syn GROUP BY 1, 2),
inside AS (SELECT feature, day, avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS score
  FROM num JOIN bounds USING (feature, day) WHERE syn AND value IS NOT NULL GROUP BY 1, 2)"""
SEEN = """seen AS (SELECT feature, day, value, bool_or(NOT syn) AS r, bool_or(syn) AS s FROM cat GROUP BY 1, 2, 3),
share AS (SELECT feature, day, CAST(count(*) FILTER (r AND s) AS DOUBLE) / nullif(count(*) FILTER (r), 0) AS score FROM seen GROUP BY 1, 2)"""
CP = pairs_sql("cp", [("event_type", "band")], "d", "day, ")
CT = tvd_cte("ct", "cp", "feature, day", "a, b")

S = {
    "CS-KSComplement": "SELECT feature, round(avg(1 - ks), 6) AS score FROM ks WHERE n_real > 0 AND n_synth > 0 GROUP BY 1",
    "CS-TVComplement": "SELECT feature, round(avg(1 - tvd), 6) AS score FROM tv WHERE n_real > 0 AND n_synth > 0 GROUP BY 1",
    "CS-StatisticSimilarity": "SELECT feature, round(avg(score), 6) AS score FROM per GROUP BY 1",
    "CS-CorrelationSim": """SELECT feature, round(avg(1 - abs(real_rho - synth_rho) / 2), 6) AS score FROM rho
      WHERE real_n >= 3 AND synth_n >= 3 AND real_rho IS NOT NULL AND synth_rho IS NOT NULL GROUP BY 1""",
    "CS-RangeCoverage": "SELECT feature, round(avg(score), 6) AS score FROM inside GROUP BY 1",
    "CS-CategoryCoverage": "SELECT feature, round(avg(score), 6) AS score FROM share GROUP BY 1",
    "CS-ContingencySim": "SELECT feature, round(avg(1 - tvd), 6) AS score FROM ct WHERE n_real > 0 AND n_synth > 0 GROUP BY 1",
}


def days(spark, folder):
    band = F.when(F.col("value") < 20, "low").when(F.col("value") < 60, "mid").otherwise("high")
    return daily_events(spark, folder).withColumn("band", band)


@add("c1_cs_ks", ctes(EV, DAYS, NUM, KS) + S["CS-KSComplement"])
def c1(spark, folder):
    return cs.ks_complement(days(spark, folder), ROLES)


@add("c2_cs_tv", ctes(EV, DAYS, CAT, TV) + S["CS-TVComplement"])
def c2(spark, folder):
    return cs.tv_complement(days(spark, folder), ROLES)


@add("c3_cs_statistics", ctes(EV, DAYS, NUM, STAT) + S["CS-StatisticSimilarity"])
def c3(spark, folder):
    return cs.statistic_similarity(days(spark, folder), ROLES)


@add("c4_cs_correlation", ctes(EV, DAYS, NP, RHO) + S["CS-CorrelationSim"])
def c4(spark, folder):
    return cs.correlation_similarity(days(spark, folder), ROLES)


@add("c5_cs_range", ctes(EV, DAYS, NUM, BOUNDS) + S["CS-RangeCoverage"])
def c5(spark, folder):
    return cs.range_coverage(days(spark, folder), ROLES)


@add("c6_cs_category_coverage", ctes(EV, DAYS, CAT, SEEN) + S["CS-CategoryCoverage"])
def c6(spark, folder):
    return cs.category_coverage(days(spark, folder), ROLES)


@add("c7_cs_contingency", ctes(EV, DAYS, CP, CT) + S["CS-ContingencySim"])
def c7(spark, folder):
    return cs.contingency_similarity(days(spark, folder), ROLES)


@add("c8_cs_suite", ctes(EV, DAYS, NUM, CAT, KS, TV, STAT, NP, RHO, BOUNDS, SEEN, CP, CT)
     + "\nUNION ALL ".join(f"SELECT '{m}' AS metric, feature, score FROM ({q}) q" for m, q in S.items()))
def c8(spark, folder):
    return cs.suite(cs.prepare(days(spark, folder), ROLES), ROLES)


@add("set2_shared_times", ctes(EV) + """
SELECT day AS ts FROM ev WHERE NOT syn INTERSECT SELECT day FROM ev WHERE syn""")
def set2(spark, folder):
    return cs.shared_times(daily_events(spark, folder), "ts")


@add("fil5_supported_numbers", ctes(EV) + """, shared AS (
  SELECT day FROM ev WHERE NOT syn INTERSECT SELECT day FROM ev WHERE syn),
c AS (SELECT count(value) FILTER (NOT syn) AS vr, count(value) FILTER (syn) AS vs, count(k) FILTER (NOT syn) AS kr,
        count(k) FILTER (syn) AS ks FROM ev WHERE day IN (SELECT day FROM shared))
SELECT 'value' AS feature FROM c WHERE vr > 0 AND vs > 0 UNION ALL SELECT 'k' FROM c WHERE kr > 0 AND ks > 0""")
def fil5(spark, folder):
    names = cs.supported_numbers(daily_events(spark, folder), ROLES)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@add("prj9_category_labels", """
SELECT l_orderkey, l_linenumber, trim(l_returnflag) AS flag, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity_label,
       CASE WHEN l_discount > 0.05 THEN 'True' ELSE 'False' END AS high_discount FROM lineitem""")
def prj9(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("quantity_label"), (F.col("l_discount") > 0.05).cast("int").alias("high_discount"),
        (F.col("l_orderkey") % 2 == 1).alias("is_synth"),
    )
    return align_labels(df, ["flag", "quantity_label", "high_discount"]).drop("is_synth")
