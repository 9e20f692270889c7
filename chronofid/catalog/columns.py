"""Static column scores over ``lineitem``, ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, Catalogue, ctes, events, ks_cte, sided, tvd_cte
from chronofid.functions.times import seconds
from chronofid.operators.moments import pair_correlations
from chronofid.operators.distributions import ks_by, tvd_by
from chronofid.plans import columns as col
from chronofid.plans.roles import summary

CATALOGUE = Catalogue()
add = CATALOGUE.add

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
CATS = ["l_returnflag", "l_linestatus", "l_linenumber"]

LI = """li AS (
  SELECT l_orderkey % 2 = 1 AS syn, l_orderkey, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax,
         epoch_us(CAST(l_shipdate AS TIMESTAMP)) / 1000000.0 AS l_shipdate,
         l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)"""
NUM = "num AS (" + " UNION ALL ".join(f"SELECT syn, '{c}' AS feature, {c} AS value FROM li" for c in NUMS) + ")"
CAT = "cat AS (" + " UNION ALL ".join(f"SELECT syn, '{c}' AS feature, {c} AS value FROM li" for c in CATS) + ")"
NUM_PAIRS = [(a, b) for i, a in enumerate(NUMS) for b in NUMS[i + 1 :]]
CAT_PAIRS = [(a, b) for i, a in enumerate(CATS) for b in CATS[i + 1 :]]


def pairs_sql(name, pairs, source, extra=""):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT syn, {extra}'{a} x {b}' AS feature, {a} AS a, {b} AS b FROM {source}" for a, b in pairs) + ")"


def corr_sql(name, source, keys):
    """Correlation per key and side; constant sides give null."""
    side = "CASE WHEN {n} > 1 AND {sa} <> 0 AND {sb} <> 0 THEN {c} / ({sa} * {sb}) END"
    parts = []
    for label, cond in (("real", "NOT syn"), ("synth", "syn")):
        parts.append(f"count(*) FILTER ({cond}) AS {label}_n, " + side.format(
            n=f"count(*) FILTER ({cond})", sa=f"stddev_pop(a) FILTER ({cond})",
            sb=f"stddev_pop(b) FILTER ({cond})", c=f"covar_pop(a, b) FILTER ({cond})") + f" AS {label}_rho")
    return f"""{name} AS (SELECT {keys}, {', '.join(parts)} FROM {source}
  WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY {keys})"""


def lineitem(spark, folder):
    df = sided(spark, folder, "lineitem", "l_orderkey")
    return df.withColumn("l_shipdate", seconds("l_shipdate"))


KS = ks_cte("ks", "num", "feature", "value")
TV = tvd_cte("tv", "(SELECT * FROM cat WHERE value IS NOT NULL) q", "feature", "value")
CONT = tvd_cte("ct", "cp", "feature", "a, b")
MEANS = """means AS (SELECT feature, avg(value) FILTER (NOT syn) AS r, avg(value) FILTER (syn) AS s FROM num GROUP BY 1)"""
SEEN = """seen AS (SELECT feature, value, bool_or(NOT syn) AS r, bool_or(syn) AS s FROM cat WHERE value IS NOT NULL GROUP BY 1, 2)"""
BOUNDS = """bounds AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM num WHERE NOT syn GROUP BY 1)"""
STATS = """st AS (SELECT syn, l_partkey, avg(l_quantity) AS mean, median(l_quantity) AS median, stddev_samp(l_quantity) AS std,
    min(l_quantity) AS min, max(l_quantity) AS max FROM li GROUP BY 1, 2)"""
MSAS = "ms AS (" + " UNION ALL ".join(f"SELECT syn, '{s}' AS feature, CAST({s} AS DOUBLE) AS value FROM st" for s in col.STATISTICS) + ")"
MKS = ks_cte("mk", "ms", "feature", "value")

S_KS = "SELECT feature, round(1 - ks, 6) AS score FROM ks"
S_TV = "SELECT feature, round(1 - tvd, 6) AS score FROM tv"
S_STAT = "SELECT feature, round(1 - abs(r - s) / (greatest(abs(r), abs(s)) + 1e-6), 6) AS score FROM means"
S_COV = "SELECT feature, round(CAST(count(*) FILTER (r AND s) AS DOUBLE) / count(*) FILTER (r), 6) AS score FROM seen GROUP BY 1"
S_RANGE = """SELECT feature, round(avg(CASE WHEN value BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS score
FROM num JOIN bounds USING (feature) WHERE syn AND value IS NOT NULL GROUP BY 1"""
S_CORR = "SELECT feature, round(1 - abs(coalesce(real_rho, 0) - coalesce(synth_rho, 0)) / 2, 6) AS score FROM rho"
S_CONT = "SELECT feature, round(1 - tvd, 6) AS score FROM ct"
S_MSAS = "SELECT 'l_partkey x l_quantity [' || feature || ']' AS feature, round(1 - ks, 6) AS score FROM mk"
NP = pairs_sql("np", NUM_PAIRS, "li")
CP = pairs_sql("cp", CAT_PAIRS, "li")
RHO = corr_sql("rho", "np", "feature")


@add("m1_ks_complement", ctes(LI, NUM, KS) + S_KS)
def m1(spark, folder):
    return col.ks_complement(lineitem(spark, folder), NUMS)


@add("m2_tv_complement", ctes(LI, CAT, TV) + S_TV)
def m2(spark, folder):
    return col.tv_complement(lineitem(spark, folder), CATS)


@add("m3_statistic_similarity", ctes(LI, NUM, MEANS) + S_STAT)
def m3(spark, folder):
    return col.statistic_similarity(lineitem(spark, folder), NUMS)


@add("m4_category_coverage", ctes(LI, CAT, SEEN) + S_COV)
def m4(spark, folder):
    return col.category_coverage(lineitem(spark, folder), CATS)


@add("m5_range_coverage", ctes(LI, NUM, BOUNDS) + S_RANGE)
def m5(spark, folder):
    return col.range_coverage(lineitem(spark, folder), NUMS)


@add("m6_correlation_sim", ctes(LI, NP, RHO) + S_CORR)
def m6(spark, folder):
    return col.correlation_similarity(lineitem(spark, folder), NUMS)


@add("m7_contingency_sim", ctes(LI, CP, CONT) + S_CONT)
def m7(spark, folder):
    return col.contingency_similarity(lineitem(spark, folder), CATS)


@add("m8_statistic_msas", ctes(LI, STATS, MSAS, MKS) + S_MSAS)
def m8(spark, folder):
    return col.statistic_msas(lineitem(spark, folder), "l_partkey", "l_quantity")


def _metric(metric, sql):
    return f"SELECT '{metric}' AS metric, feature, score FROM ({sql}) q"


SUITE = ctes(LI, NUM, CAT, KS, TV, MEANS, SEEN, BOUNDS, NP, RHO, CP, CONT, STATS, MSAS, MKS) + "\nUNION ALL ".join([
    _metric("KSComplement", S_KS), _metric("StatisticSimilarity", S_STAT), _metric("RangeCoverage", S_RANGE),
    _metric("CorrelationSim", S_CORR), _metric("TVComplement", S_TV), _metric("CategoryCoverage", S_COV),
    _metric("ContingencySim", S_CONT), _metric("StatisticMSAS", S_MSAS)])


@add("m9_static_suite", SUITE)
def m9(spark, folder):
    return col.suite(lineitem(spark, folder), NUMS, CATS, [("l_partkey", "l_quantity")])


@add("agg1_ks_by_type", ctes(EV, ks_cte("x", "ev", "event_type", "value")) + """
SELECT event_type, CAST(n_real AS BIGINT) AS n_real, CAST(n_synth AS BIGINT) AS n_synth,
       round(ks, 6) AS ks, round(1 - ks, 6) AS complement, round(w1, 6) AS w1 FROM x""")
def agg1(spark, folder):
    df = ks_by(events(spark, folder), ["event_type"], "value")
    return df.select("event_type", "n_real", "n_synth", "ks", (1 - F.col("ks")).alias("complement"), "w1")


@add("agg2_tvd_by_status", """WITH o AS (SELECT o_orderkey % 2 = 1 AS syn, o_orderstatus, o_orderpriority FROM orders),
""" + tvd_cte("x", "o", "o_orderstatus", "o_orderpriority") + """
SELECT o_orderstatus, round(tvd, 6) AS tvd, round(1 - tvd, 6) AS complement FROM x""")
def agg2(spark, folder):
    df = tvd_by(sided(spark, folder, "orders", "o_orderkey"), ["o_orderstatus"], ["o_orderpriority"])
    return df.select("o_orderstatus", "tvd", (1 - F.col("tvd")).alias("complement"))


@add("agg3_guarded_pearson", ctes(LI, pairs_sql("np", [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")],
                                                "li", "l_returnflag, "), corr_sql("rho", "np", "l_returnflag, feature")) + """
SELECT l_returnflag, feature, real_n, synth_n, round(real_rho, 6) AS real_rho, round(synth_rho, 6) AS synth_rho FROM rho""")
def agg3(spark, folder):
    pairs = [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    return pair_correlations(lineitem(spark, folder), ["l_returnflag"], pairs)


@add("agg4_entity_statistics", ctes(LI) + """
SELECT syn AS is_synth, l_partkey, count(l_quantity) AS count, round(avg(l_quantity), 6) AS mean,
       round(median(l_quantity), 6) AS median, round(stddev_samp(l_quantity), 6) AS std,
       round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max FROM li GROUP BY 1, 2""")
def agg4(spark, folder):
    return col.entity_statistics(lineitem(spark, folder), ["is_synth", "l_partkey"], "l_quantity")


@add("agg9_score_means", "WITH s AS (" + SUITE + """) SELECT metric, round(avg(score), 6) AS score FROM s GROUP BY 1""")
def agg9(spark, folder):
    return summary(m9(spark, folder))


@add("fil7_contingency_pairs", ctes(LI) + """, d AS (
  SELECT count(DISTINCT l_returnflag) AS rf, count(DISTINCT l_linestatus) AS ls, count(DISTINCT l_linenumber) AS ln,
         count(DISTINCT l_partkey) AS pk FROM li WHERE NOT syn)
SELECT a, b FROM (
  SELECT 'l_returnflag' AS a, 'l_linestatus' AS b, rf * ls AS n FROM d UNION ALL SELECT 'l_returnflag', 'l_linenumber', rf * ln FROM d
  UNION ALL SELECT 'l_returnflag', 'l_partkey', rf * pk FROM d UNION ALL SELECT 'l_linestatus', 'l_linenumber', ls * ln FROM d
  UNION ALL SELECT 'l_linestatus', 'l_partkey', ls * pk FROM d UNION ALL SELECT 'l_linenumber', 'l_partkey', ln * pk FROM d) q
WHERE n <= 500""")
def fil7(spark, folder):
    cats = ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"]
    pairs = col.contingency_pairs(lineitem(spark, folder), cats, limit=500)
    return spark.createDataFrame(pairs, "a string, b string")
