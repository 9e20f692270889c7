"""Timestamp scores over ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, EVENT_ROLES, Catalogue, ctes, events, ks_cte, sided
from chronofid.functions.times import seconds
from chronofid.plans import timestamps as ts
from chronofid.plans.roles import TableRoles

CATALOGUE = Catalogue()
add = CATALOGUE.add

ORDER_ROLES = TableRoles(key="o_custkey", time="o_orderdate", row="o_orderkey", periodicity="regular")
DAY = 86400.0

STEPS = """steps AS (
  SELECT syn, user_id, t - lag(t) OVER (PARTITION BY syn, user_id ORDER BY t, event_id) AS d,
         t - lag(t) OVER (PARTITION BY syn, user_id ORDER BY event_id) AS file_d
  FROM ev)"""
ORD = """ord AS (
  SELECT o_orderkey, o_custkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 1000000.0 AS t, o_orderkey % 2 = 1 AS syn FROM orders)"""
ORD_STEPS = """steps AS (
  SELECT syn, o_custkey, t - lag(t) OVER (PARTITION BY syn, o_custkey ORDER BY t, o_orderkey) AS d FROM ord)"""


def orders(spark, folder):
    return sided(spark, folder, "orders", "o_orderkey")


def since_first(spark, folder):
    """Orders with time counted in days from the customer's first order."""
    days = seconds("o_orderdate") / DAY
    timed = orders(spark, folder).withColumn("o_orderdate", days)
    return ts.elapsed_time(timed, ORDER_ROLES)


REL = """rel AS (
  SELECT o_orderkey, o_custkey, syn, (t - min(t) OVER (PARTITION BY syn, o_custkey)) / 86400.0 AS e FROM ord)"""


@add("t1_order_consistency", ctes(EV, STEPS) + """
SELECT round(1 - avg(CASE WHEN file_d < 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM steps WHERE syn AND file_d IS NOT NULL""")
def t1(spark, folder):
    return ts.order_consistency(events(spark, folder), EVENT_ROLES)


@add("t1_order_consistency_orders", ctes(ORD, """steps AS (
  SELECT syn, t - lag(t) OVER (PARTITION BY syn, o_custkey ORDER BY o_orderkey) AS d FROM ord)""") + """
SELECT round(1 - avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM steps WHERE syn AND d IS NOT NULL""")
def t1_orders(spark, folder):
    return ts.order_consistency(orders(spark, folder), ORDER_ROLES)


@add("t2_timestamp_uniqueness", ctes(ORD, ORD_STEPS) + """
SELECT round(1 - avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM steps WHERE syn AND d IS NOT NULL""")
def t2(spark, folder):
    return ts.uniqueness(orders(spark, folder), ORDER_ROLES)


@add("t3_duration_similarity", ctes(EV, "dur AS (SELECT syn, user_id, max(t) - min(t) AS d FROM ev GROUP BY 1, 2)",
                                    ks_cte("x", "dur", "", "d")) + """
SELECT round(1 - ks, 6) AS score FROM x""")
def t3(spark, folder):
    return ts.duration_similarity(events(spark, folder), EVENT_ROLES).select("score")


@add("t4_range_compliance_absolute", ctes(EV) + """
SELECT round(1 - avg(CASE WHEN t < lo OR t > hi THEN 1.0 ELSE 0.0 END), 6) AS score
FROM ev, (SELECT min(t) AS lo, max(t) AS hi FROM ev WHERE NOT syn) WHERE syn""")
def t4_absolute(spark, folder):
    return ts.range_compliance(events(spark, folder), EVENT_ROLES, "Absolute")


@add("t4_range_compliance_relative", ctes(ORD, """days AS (
  SELECT o_orderkey, o_custkey, syn, (t - (SELECT min(t) FROM ord)) / 86400.0 AS e FROM ord)""", """
firsts AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY e, o_orderkey) AS rn FROM days WHERE syn)""") + """
SELECT round(1 - avg(CASE WHEN e < 0 OR e > hi OR (rn = 1 AND abs(e) > 1e-8) THEN 1.0 ELSE 0.0 END), 6) AS score
FROM firsts, (SELECT max(d) AS hi FROM (SELECT max(e) - min(e) AS d FROM days WHERE NOT syn GROUP BY o_custkey))""")
def t4_relative(spark, folder):
    df = orders(spark, folder)
    start = df.agg(F.min(seconds("o_orderdate")).alias("_start"))
    days = (seconds("o_orderdate") - F.col("_start")) / DAY
    shifted = df.join(F.broadcast(start), F.lit(True), "left").withColumn("o_orderdate", days).drop("_start")
    return ts.range_compliance(shifted, ORDER_ROLES, "Relative")


@add("t5_regularity", ctes(EV, STEPS) + """
SELECT round(1 - avg(CASE WHEN abs(d - 3600) > 36 THEN 1.0 ELSE 0.0 END), 6) AS score
FROM steps WHERE syn AND d IS NOT NULL""")
def t5(spark, folder):
    return ts.regularity(events(spark, folder), EVENT_ROLES, 3600.0)


@add("t6_grid_completeness", ctes(EV, """
cell AS (SELECT DISTINCT syn, user_id, CAST(round_even(t / 86400.0, 0) AS BIGINT) AS c FROM ev)""", """
runs AS (SELECT user_id, min(c) AS lo, count(*) AS n FROM cell WHERE NOT syn GROUP BY 1)""", """
rc AS (SELECT unnest(range(lo, lo + n)) AS c FROM runs)""", """
r AS (SELECT c, count(*) AS r FROM rc GROUP BY 1)""", """
s AS (SELECT c, count(*) AS s FROM cell WHERE syn GROUP BY 1)""", """
j AS (SELECT r.c, r, coalesce(s, 0) AS s FROM r LEFT JOIN s ON r.c = s.c)""") + """
SELECT round(CAST(sum(least(r, s)) AS DOUBLE) / sum(r), 6) AS score,
       round(CAST(count(*) FILTER (s > 0) AS DOUBLE) / count(*), 6) AS support_coverage,
       round(CAST(sum(least(r, s)) AS DOUBLE) / sum(r) FILTER (s > 0), 6) AS multiplicity_preservation
FROM j""")
def t6(spark, folder):
    return ts.grid_completeness(events(spark, folder), EVENT_ROLES, DAY)


@add("t7_time_interval_sim", ctes(EV, STEPS, ks_cte("x", "steps", "", "d")) + """
SELECT round(1 - ks, 6) AS score FROM x""")
def t7(spark, folder):
    return ts.interval_similarity(events(spark, folder), EVENT_ROLES).select("score")


@add("t8_periodicity", ctes(ORD, ORD_STEPS) + """
SELECT 'Regular' AS periodicity, round(median(CAST(d AS DOUBLE)), 6) AS interval FROM steps WHERE NOT syn AND d IS NOT NULL""")
def t8(spark, folder):
    return ts.periodicity(orders(spark, folder), ORDER_ROLES)


@add("t8_periodicity_detected", ctes(EV, STEPS) + """
SELECT CASE WHEN avg(d) <> 0 AND stddev_pop(d) / avg(d) < 0.01 THEN 'Regular' ELSE 'Irregular' END AS periodicity,
       CASE WHEN avg(d) <> 0 AND stddev_pop(d) / avg(d) < 0.01 THEN round(median(CAST(d AS DOUBLE)), 6) END AS interval
FROM steps WHERE NOT syn AND d IS NOT NULL""")
def t8_detected(spark, folder):
    return ts.periodicity(events(spark, folder), EVENT_ROLES)


@add("t9_representation", ctes(EV) + """
SELECT CASE WHEN min(s) = max(s) THEN 'Relative' ELSE 'Absolute' END AS representation
FROM (SELECT min(t) AS s FROM ev WHERE NOT syn GROUP BY user_id)""")
def t9(spark, folder):
    return ts.representation(events(spark, folder), EVENT_ROLES)


@add("t10_timestamp_suite", ctes(EV, STEPS, ks_cte("i", "steps", "", "d"),
                                 "dur AS (SELECT syn, user_id, max(t) - min(t) AS d FROM ev GROUP BY 1, 2)",
                                 ks_cte("u", "dur", "", "d")) + """
SELECT 'TemporalOrderConsistency' AS metric, '*' AS feature,
       round(1 - avg(CASE WHEN file_d < 0 THEN 1.0 ELSE 0.0 END), 6) AS score FROM steps WHERE syn AND file_d IS NOT NULL
UNION ALL SELECT 'TimestampUniqueness', '*', round(1 - avg(CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END), 6) FROM steps WHERE syn AND d IS NOT NULL
UNION ALL SELECT 'TrajectoryDurationSimilarity', '*', round(1 - ks, 6) FROM u
UNION ALL SELECT 'TemporalRangeCompliance', '*', round(1 - avg(CASE WHEN t < lo OR t > hi THEN 1.0 ELSE 0.0 END), 6)
  FROM ev, (SELECT min(t) AS lo, max(t) AS hi FROM ev WHERE NOT syn) WHERE syn
UNION ALL SELECT 'RegularityConsistency', '*', NULL
UNION ALL SELECT 'GridCompleteness', '*', NULL
UNION ALL SELECT 'TimeIntervalDistributionSim', '*', round(1 - ks, 6) FROM i""")
def t10(spark, folder):
    return ts.suite(events(spark, folder), EVENT_ROLES)


@add("prj7_elapsed_time", ctes(ORD, REL) + """
SELECT o_orderkey, round(e, 6) AS elapsed FROM rel""")
def prj7(spark, folder):
    return since_first(spark, folder).select("o_orderkey", F.col("o_orderdate").alias("elapsed"))


@add("win1_time_difference", ctes(EV, """d AS (
  SELECT event_id, t - lag(t) OVER (PARTITION BY syn, user_id ORDER BY t, event_id) AS step FROM ev)""") + """
SELECT event_id, round(step, 6) AS "interval" FROM d WHERE step IS NOT NULL""")
def win1(spark, folder):
    return ts.intervals(events(spark, folder), EVENT_ROLES).select("event_id", "interval")


@add("win2_file_order_difference", ctes(ORD, """d AS (
  SELECT o_orderkey, t - lag(t) OVER (PARTITION BY syn, o_custkey ORDER BY o_orderkey) AS step FROM ord)""") + """
SELECT o_orderkey, round(step, 6) AS "interval" FROM d WHERE step IS NOT NULL""")
def win2(spark, folder):
    return ts.intervals(orders(spark, folder), ORDER_ROLES, file_order=True).select("o_orderkey", "interval")


@add("agg8_characteristics", ctes(EV) + """
SELECT syn AS is_synth, count(*) AS total_observations, count(DISTINCT user_id) AS num_flows FROM ev GROUP BY 1""")
def agg8(spark, folder):
    return ts.characteristics(events(spark, folder), EVENT_ROLES)
