"""Joins and structural scores over customer, orders, lineitem and their parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, EVENT_ROLES, Catalogue, ctes, events, ks_cte, sided, table
from chronofid.catalog.columns import corr_sql
from chronofid.functions.labels import join_key
from chronofid.operators import joins
from chronofid.operators.joins import Relationship
from chronofid.operators.sampling import first_rows, sample_entities, stratified_folds, stratified_split
from chronofid.plans import repair
from chronofid.plans import structure as st
from chronofid.plans.roles import TableRoles

CATALOGUE = Catalogue()
add = CATALOGUE.add

RELATIONSHIPS = [
    Relationship("region", "nation", "r_regionkey", "n_regionkey"),
    Relationship("nation", "customer", "n_nationkey", "c_nationkey"),
    Relationship("customer", "orders", "c_custkey", "o_custkey"),
    Relationship("orders", "lineitem", "o_orderkey", "l_orderkey"),
    Relationship("part", "lineitem", "p_partkey", "l_partkey"),
]
ORDER_ROLES = TableRoles(key="o_custkey", time="o_orderdate", row="o_orderkey")
MONTH = 30 * st.DAY


def tables(spark, folder):
    names = ["region", "nation", "customer", "orders", "lineitem", "part"]
    found = {n: table(spark, folder, n) for n in names}
    found["orders"] = sided(spark, folder, "orders", "o_orderkey")
    return found


@add("joi1_flatten", """
SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, c_mktsegment, n_name, r_name, p_brand,
       round(o_totalprice, 6) AS o_totalprice
FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN part ON l_partkey = p_partkey""")
def joi1(spark, folder):
    flat = joins.flatten(tables(spark, folder), RELATIONSHIPS, "lineitem")
    return flat.select(
        "l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_mktsegment", "n_name", "r_name", "p_brand", "o_totalprice"
    )


@add("joi2_flatten_mixed_keys", """
SELECT o_orderkey, o_custkey, o_orderstatus, c_custkey, c_mktsegment, n_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def joi2(spark, folder):
    found = tables(spark, folder)
    # The child keeps its key as a float and the parent as text, as files of two sources may.
    found["orders"] = found["orders"].withColumn("o_custkey", F.col("o_custkey").cast("double"))
    found["customer"] = found["customer"].withColumn("c_custkey", F.col("c_custkey").cast("string"))
    flat = joins.flatten(found, RELATIONSHIPS, "orders", collisions="drop")
    return flat.select(
        "o_orderkey", F.col("o_custkey").cast("long").alias("o_custkey"), "o_orderstatus",
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_mktsegment", "n_name",
    )


@add("prj10_join_key", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS key_from_float,
       CAST(l_suppkey AS VARCHAR) AS key_from_long FROM lineitem""")
def prj10(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", join_key("l_quantity").alias("key_from_float"), join_key("l_suppkey").alias("key_from_long")
    )


SIBLING = """WITH s AS (SELECT l_suppkey AS key, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1)
"""


def sibling(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_suppkey", "key")
    parts = table(spark, folder, "part").withColumnRenamed("p_partkey", "key")
    return joins.attach_sibling_sums(parts.select("key", "p_retailprice"), lines, ["key"], ["l_quantity"])


@add("joi3_sibling_sums", SIBLING + """
SELECT p_partkey AS key, round(p_retailprice, 6) AS p_retailprice, round(l_quantity, 6) AS l_quantity
FROM part LEFT JOIN s ON p_partkey = s.key""")
def joi3(spark, folder):
    return sibling(spark, folder)


@add("joi3_sibling_coverage", SIBLING + """
SELECT count(l_quantity) AS matched_rows, count(*) AS total_rows, round(CAST(count(l_quantity) AS DOUBLE) / count(*), 6) AS coverage
FROM part LEFT JOIN s ON p_partkey = s.key""")
def joi3_coverage(spark, folder):
    return joins.coverage(sibling(spark, folder), "l_quantity")


@add("joi4_khop_join", """
SELECT n_name AS "nation__n_name", round(l_quantity, 6) AS "lineitem__l_quantity", l_linenumber AS "lineitem__l_linenumber",
       l_orderkey AS "lineitem__l_orderkey"
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey""")
def joi4(spark, folder):
    path = joins.find_path(RELATIONSHIPS, "nation", "lineitem")
    needed = [("nation", "n_name"), ("lineitem", "l_quantity"), ("lineitem", "l_linenumber"), ("lineitem", "l_orderkey")]
    joined = joins.khop_join(tables(spark, folder), "nation", path, needed)
    return joined.select(*["__".join(c) for c in needed])


@add("joi5_attach_totals", """
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS a, avg(l_extendedprice) AS b, stddev_samp(l_extendedprice) AS c, count(l_linenumber) AS d
  FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, round(coalesce(a, 0), 6) AS sales_sum, round(coalesce(b, 0), 6) AS sales_mean,
       round(coalesce(c, 0), 6) AS sales_std, coalesce(d, 0) AS sales_count FROM orders LEFT JOIN s ON o_orderkey = s.l_orderkey""")
def joi5(spark, folder):
    flow = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.attach_totals(flow, table(spark, folder, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber", "sales")


@add("joi6_labelled_features", """
SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL""")
def joi6(spark, folder):
    features = table(spark, folder, "documents").select("doc_id", "n_chars")
    return joins.with_labels(features, table(spark, folder, "labels"), "doc_id", "quality")


SEED = 7
CHOSEN = f"""chosen AS (SELECT c_custkey FROM customer ORDER BY md5('{SEED}:' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100),
o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM chosen)),
l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)),
p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l))"""


@add("joi7_referential_sample", ctes(CHOSEN) + """
SELECT 'customer' AS name, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS id_sum FROM chosen
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM o
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_partkey) AS BIGINT) FROM l
UNION ALL SELECT 'part', count(*), CAST(sum(p_partkey) AS BIGINT) FROM p""")
def joi7(spark, folder):
    customer = sample_entities(table(spark, folder, "customer"), ["c_custkey"], 100, SEED)
    orders = table(spark, folder, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    lines = table(spark, folder, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    part = table(spark, folder, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"), "left_semi")

    def size(df, name, key):
        return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("id_sum"))

    return (
        size(customer, "customer", "c_custkey")
        .unionByName(size(orders, "orders", "o_orderkey"))
        .unionByName(size(lines, "lineitem", "l_partkey"))
        .unionByName(size(part, "part", "p_partkey"))
    )


@add("smp1_entity_sample", f"""
WITH c AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5('{SEED}:' || CAST(user_id AS VARCHAR)), user_id LIMIT 40)
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM c)""")
def smp1(spark, folder):
    return sample_entities(table(spark, folder, "events"), ["user_id"], 40, SEED).select("event_id", "user_id")


PLACED = f"""p AS (SELECT doc_id, quality,
    row_number() OVER (PARTITION BY quality ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY quality) AS n FROM labels)"""


@add("smp2_stratified_split", ctes(PLACED) + """SELECT doc_id, quality, pos < round_even(n * 0.2, 0) AS is_test FROM p""")
def smp2(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", "quality")
    return stratified_split(df, "quality", ["doc_id"], SEED)


@add("smp2_stratified_folds", ctes(PLACED) + """SELECT doc_id, quality, CAST(pos % 5 AS INTEGER) AS fold FROM p""")
def smp2_folds(spark, folder):
    df = table(spark, folder, "labels").select("doc_id", "quality")
    return stratified_folds(df, "quality", ["doc_id"], SEED)


@add("set1_first_per_key", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) q WHERE rn = 1""")
def set1(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("row_ix"),
    )
    return first_rows(lines, ["l_orderkey"], "row_ix").drop("row_ix")


@add("set1_full_row", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def set1_full(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), F.col("event_id").alias(repair.ORDER))
    return repair.deduplicate(rows, repair.RepairRules(key="user_id", time="day", dedup="full_row")).drop(repair.ORDER)


@add("set4_parent_union", """
SELECT c_custkey AS id FROM customer UNION SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL""")
def set4(spark, folder):
    parents = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    seen = table(spark, folder, "orders").where(F.col("o_custkey").isNotNull()).select(F.col("o_custkey").alias("id"))
    return parents.union(seen).distinct()


LEN = """len AS (SELECT o_orderkey % 2 = 1 AS syn, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2)"""


@add("s1_sequence_length", ctes(LEN, ks_cte("x", "len", "", "n")) + """
SELECT round(1 - ks, 6) AS score, CAST(n_real AS BIGINT) AS real_flows, CAST(n_synth AS BIGINT) AS synth_flows,
  round(avg(n) FILTER (NOT syn), 6) AS real_mean, round(stddev_pop(n) FILTER (NOT syn), 6) AS real_std,
  min(n) FILTER (NOT syn) AS real_min, max(n) FILTER (NOT syn) AS real_max,
  round(avg(n) FILTER (syn), 6) AS synth_mean, round(stddev_pop(n) FILTER (syn), 6) AS synth_std,
  min(n) FILTER (syn) AS synth_min, max(n) FILTER (syn) AS synth_max,
  round(median(n) FILTER (NOT syn), 6) AS real_median, round(median(n) FILTER (syn), 6) AS synth_median
FROM x, len GROUP BY ks, n_real, n_synth""")
def s1(spark, folder):
    return st.length_similarity(sided(spark, folder, "orders", "o_orderkey"), ORDER_ROLES)


CARD = f"""o AS (SELECT o_orderkey % 2 = 1 AS syn, o_custkey, CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP)) / {MONTH}) AS BIGINT) AS w,
    epoch(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders),
b AS (SELECT min(w) AS w0, CAST(ceil(max(t) / {MONTH}) AS BIGINT) AS w1 FROM o WHERE NOT syn),
par AS (SELECT syn, c_custkey AS id FROM customer, (VALUES (true), (false)) s(syn) UNION SELECT syn, o_custkey FROM o),
win AS (SELECT unnest(range(w0, w1)) AS w FROM b),
cells AS (SELECT par.syn, par.id, win.w, count(o.o_custkey) AS n FROM par CROSS JOIN win
  LEFT JOIN o ON o.syn = par.syn AND o.o_custkey = par.id AND o.w = win.w GROUP BY 1, 2, 3)"""


@add("s2_cardinality_shape", ctes(CARD, ks_cte("x", "cells", "", "n"), ks_cte("pw", "cells", "w", "n")) + """
SELECT round(1 - ks, 6) AS score, round((SELECT avg(1 - ks) FROM pw), 6) AS per_window_mean, (SELECT count(*) FROM win) AS n_windows,
  (SELECT count(*) FROM par WHERE NOT syn) AS real_parents, (SELECT count(*) FROM par WHERE syn) AS synth_parents FROM x""")
def s2(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"))
    parents = customers.withColumn("is_synth", F.explode(F.array(F.lit(False), F.lit(True))))
    return st.cardinality_similarity(sided(spark, folder, "orders", "o_orderkey"), ORDER_ROLES, MONTH, parents)


KHOP = f"""j AS (SELECT o_orderkey % 2 = 1 AS syn, c_acctbal AS a, l_extendedprice AS b,
    CAST(floor(epoch(CAST(o_orderdate AS TIMESTAMP)) / {MONTH}) AS BIGINT) AS bin
  FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey)"""


@add("s3_khop_correlation", ctes(KHOP, corr_sql("rho", "j", "bin")) + """
SELECT CASE WHEN count(*) >= 2 THEN round(1 - avg(abs(real_rho - synth_rho)) / 2, 6) END AS score,
       round(avg(abs(real_rho - synth_rho)), 6) AS mae, count(*) AS n_bins
FROM rho WHERE real_n >= 5 AND synth_n >= 5 AND real_rho IS NOT NULL AND synth_rho IS NOT NULL""")
def s3(spark, folder):
    path = joins.find_path(RELATIONSHIPS, "customer", "lineitem")
    return st.khop_similarity(
        tables(spark, folder), path, ("customer", "c_acctbal"), ("lineitem", "l_extendedprice"),
        ("orders", "o_orderdate"), ("orders", "is_synth"), MONTH,
    )


@add("s4_window_width", """
WITH d AS (SELECT DISTINCT epoch(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders WHERE o_orderkey % 2 = 0),
s AS (SELECT median(step) AS m FROM (SELECT t - lag(t) OVER (ORDER BY t) AS step FROM d) q)
SELECT round(CAST(m AS DOUBLE), 6) AS median_step,
  CAST(CASE WHEN m >= 28 * 86400 THEN 30 * 86400 WHEN m >= 7 * 86400 THEN 7 * 86400 WHEN m >= 86400 THEN 86400 ELSE 3600 END AS BIGINT) AS width
FROM s""")
def s4(spark, folder):
    return st.window_width(sided(spark, folder, "orders", "o_orderkey"), ORDER_ROLES)


@add("s4_window_width_events", ctes(EV) + """, d AS (SELECT DISTINCT t FROM ev WHERE NOT syn),
s AS (SELECT median(step) AS m FROM (SELECT t - lag(t) OVER (ORDER BY t) AS step FROM d) q)
SELECT round(CAST(m AS DOUBLE), 6) AS median_step,
  CAST(CASE WHEN m >= 28 * 86400 THEN 30 * 86400 WHEN m >= 7 * 86400 THEN 7 * 86400 WHEN m >= 86400 THEN 86400 ELSE 3600 END AS BIGINT) AS width
FROM s""")
def s4_events(spark, folder):
    return st.window_width(events(spark, folder), EVENT_ROLES)
