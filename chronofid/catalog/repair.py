"""Table repair over ``events``: odd events are snapped onto the days of the even ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, Catalogue, ctes, events, table
from chronofid.operators.fill import modes
from chronofid.operators.ordered import ordered
from chronofid.operators.snap import nearest, to_step
from chronofid.plans import repair as rp
from chronofid.plans.repair import RepairRules

CATALOGUE = Catalogue()
add = CATALOGUE.add

RULES = RepairRules(key="user_id", time="day", row="event_id", num_cols=["value", "k"], cat_cols=["event_type"])
COLS = ["user_id", "day", "value", "k", "event_type", "_is_imputed"]


def real(spark, folder):
    df = events(spark, folder).where("not is_synth")
    return df.select("event_id", "user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "value", "k", "event_type")


def synth(spark, folder):
    df = events(spark, folder).where("is_synth")
    return df.select("event_id", "user_id", F.col("ts").alias("day"), "value", "k", "event_type")


def repaired(spark, folder, method):
    return rp.repair(synth(spark, folder), real(spark, folder), RULES, method).select(*COLS)


SNAP = """grid AS (SELECT d, ix, lag(d) OVER (ORDER BY d) AS prev, lead(d) OVER (ORDER BY d) AS next FROM (
    SELECT CAST(day AS TIMESTAMP) AS d, row_number() OVER (ORDER BY day) AS ix FROM (SELECT DISTINCT day FROM ev WHERE NOT syn) a) b),
cellz AS (SELECT d, epoch_us(prev) / 2.0 + epoch_us(d) / 2.0 AS lo, epoch_us(d) / 2.0 + epoch_us(next) / 2.0 AS hi FROM grid),
snapped AS (SELECT e.event_id, e.user_id, e.ts, g.d, e.value, e.k, e.event_type FROM ev e JOIN cellz g
  ON (lo IS NULL OR epoch_us(e.ts) > lo) AND (hi IS NULL OR epoch_us(e.ts) <= hi) WHERE e.syn)"""
DEDUP = """dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS rn FROM snapped) q WHERE rn = 1)"""
GRID = """rb AS (SELECT user_id, CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM ev WHERE NOT syn GROUP BY 1),
al AS (SELECT CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM ev WHERE NOT syn),
bnd AS (SELECT s.user_id, greatest(coalesce(rb.lo, al.lo), s.lo) AS lo, coalesce(rb.hi, al.hi) AS hi
  FROM (SELECT user_id, min(d) AS lo FROM dedup GROUP BY 1) s LEFT JOIN rb USING (user_id), al),
merged AS (SELECT b.user_id, g.d, x.event_id, x.value, x.k, x.event_type, x.event_id IS NULL AS imp
  FROM bnd b JOIN grid g ON g.d BETWEEN b.lo AND b.hi LEFT JOIN dedup x ON x.user_id = b.user_id AND x.d = g.d)"""
PIPE = ctes(EV, SNAP, DEDUP, GRID)
KNOWN = ", kn AS (SELECT *, bool_or(imp) OVER (PARTITION BY user_id) AS gappy, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER p AS f_{c}, first_value({c} IGNORE NULLS) OVER n AS b_{c}, "
    f"last_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER p AS fi_{c}, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN i END IGNORE NULLS) OVER n AS bi_{c}"
    for c in ("value", "k", "event_type")) + """
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d) AS i FROM merged) q
  WINDOW p AS (PARTITION BY user_id ORDER BY d ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


def _lerp(c):
    return (f"CASE WHEN NOT gappy OR {c} IS NOT NULL THEN {c} WHEN f_{c} IS NULL THEN b_{c} WHEN b_{c} IS NULL THEN f_{c} "
            f"ELSE f_{c} + (b_{c} - f_{c}) / (bi_{c} - fi_{c}) * (i - fi_{c}) END")


MODE = """, cnt AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn
  FROM merged WHERE NOT imp AND event_type IS NOT NULL GROUP BY 1, 2),
ent AS (SELECT user_id, avg(value) FILTER (NOT imp) AS mv, avg(k) FILTER (NOT imp) AS mk FROM merged GROUP BY 1)
"""


@add("g1_repair_pipeline_dedup_only", ctes(EV, SNAP, DEDUP) + """
SELECT user_id, d AS day, round(value, 6) AS value, round(k, 6) AS k, event_type, false AS "_is_imputed" FROM dedup""")
def g1(spark, folder):
    from dataclasses import replace

    rules = replace(RULES, regular=False)
    return rp.repair(synth(spark, folder), real(spark, folder), rules).select(*COLS)


@add("g3_sparse_grid", PIPE + """
SELECT user_id, d AS day, round(value, 6) AS value, round(k, 6) AS k, event_type, imp AS "_is_imputed" FROM merged""")
def g3(spark, folder):
    return repaired(spark, folder, "sparse")


@add("g4_id_fill", PIPE + MODE + """
SELECT m.user_id, d AS day, round(CASE WHEN imp THEN mv ELSE value END, 6) AS value, round(CASE WHEN imp THEN mk ELSE k END, 6) AS k,
  CASE WHEN imp THEN c.event_type ELSE m.event_type END AS event_type, imp AS "_is_imputed"
FROM merged m JOIN ent e ON m.user_id = e.user_id LEFT JOIN cnt c ON c.user_id = m.user_id AND c.rn = 1""")
def g4_id(spark, folder):
    return repaired(spark, folder, "id_fill")


@add("g4_prev_fill", PIPE + KNOWN + """
SELECT user_id, d AS day, round(CASE WHEN gappy THEN f_value ELSE value END, 6) AS value, round(CASE WHEN gappy THEN f_k ELSE k END, 6) AS k,
  CASE WHEN gappy THEN f_event_type ELSE event_type END AS event_type, imp AS "_is_imputed" FROM kn""")
def g4_prev(spark, folder):
    return repaired(spark, folder, "prev_fill")


@add("g4_interp_fill", PIPE + KNOWN + f"""
SELECT user_id, d AS day, round({_lerp('value')}, 6) AS value, round({_lerp('k')}, 6) AS k,
  CASE WHEN gappy THEN coalesce(f_event_type, b_event_type) ELSE event_type END AS event_type, imp AS "_is_imputed" FROM kn""")
def g4_interp(spark, folder):
    return repaired(spark, folder, "interp_fill")


@add("g5_repair_report", PIPE + """
SELECT (SELECT count(*) FROM ev WHERE syn) AS total_rows_before, count(*) AS total_rows_after,
  (SELECT count(*) FROM ev WHERE syn) - count(*) + count(*) FILTER (imp) AS rows_removed, count(*) FILTER (imp) AS imputed_rows,
  round(CAST(count(*) FILTER (imp) AS DOUBLE) / count(*), 6) AS imputation_ratio,
  (SELECT count(DISTINCT user_id) FROM ev WHERE syn) AS flows_before, count(DISTINCT user_id) AS flows_after,
  (SELECT count(DISTINCT user_id) FROM ev WHERE NOT syn) AS real_flows,
  round((SELECT avg(n) FROM (SELECT count(*) AS n FROM ev WHERE syn GROUP BY user_id) q), 4) AS avg_flow_length_before,
  round(CAST(count(*) AS DOUBLE) / count(DISTINCT user_id), 4) AS avg_flow_length_after FROM merged""")
def g5(spark, folder):
    before, source = synth(spark, folder), real(spark, folder)
    after = rp.repair(before, source, RULES, "sparse")
    return rp.report(before, after, source, RULES)


@add("g2_snap_integer", """SELECT event_id, CAST(round_even((value - 1) / 4, 0) * 4 + 1 AS BIGINT) AS snapped FROM events""")
def g2(spark, folder):
    return events(spark, folder).select("event_id", to_step("value", 4, 1).alias("snapped"))


MISSING = """m AS (SELECT l_orderkey, greatest(max(l_linenumber) - count(DISTINCT l_linenumber) FILTER (l_linenumber >= 1), 0) AS missing
  FROM lineitem GROUP BY 1)"""


@add("g6_sequence_report", ctes(MISSING) + """
SELECT count(*) AS keys_total, count(*) FILTER (missing > 0) AS keys_with_gaps,
  round(1 - CAST(count(*) FILTER (missing > 0) AS DOUBLE) / count(*), 6) AS complete_ratio, CAST(sum(missing) AS BIGINT) AS missing_total,
  round(avg(missing) FILTER (missing > 0), 4) AS avg_missing FROM m""")
def g6(spark, folder):
    return rp.sequence_report(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@add("set5_missing_numbers", ctes(MISSING) + "SELECT l_orderkey, CAST(missing AS BIGINT) AS missing FROM m")
def set5(spark, folder):
    return rp.missing_numbers(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@add("joi8_nearest_snap", ctes(EV, SNAP) + "SELECT event_id, user_id, d AS day, round(value, 6) AS value FROM snapped")
def joi8(spark, folder):
    return nearest(synth(spark, folder), real(spark, folder), "day").select("event_id", "user_id", "day", "value")


@add("joi8_nearest_snap_with_end", """
WITH grid AS (SELECT p, lag(p) OVER (ORDER BY p) AS prev, lead(p) OVER (ORDER BY p) AS next FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS p FROM part) a),
cellz AS (SELECT p, (prev + p) / 2 AS lo, (p + next) / 2 AS hi FROM grid)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(p, 6) AS l_tax_start, round(l_discount + p - l_tax * 600, 6) AS l_end
FROM lineitem JOIN cellz ON (lo IS NULL OR l_tax * 600 > lo) AND (hi IS NULL OR l_tax * 600 <= hi)""")
def joi8_end(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_tax") * 600).alias("l_tax_start"), F.col("l_discount").alias("l_end")
    )
    sizes = table(spark, folder, "part").select(F.col("p_size").cast("double").alias("l_tax_start"))
    return nearest(lines, sizes, "l_tax_start", end="l_end")


DAILY = """u AS (SELECT user_id, day, sum(value) AS value FROM ev GROUP BY 1, 2)"""


@add("joi9_grid_left_join", ctes(EV, DAILY) + """, b AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM u GROUP BY 1),
g AS (SELECT user_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b)
SELECT g.user_id, g.day, round(value, 6) AS value, u.user_id IS NULL AS "_is_imputed" FROM g LEFT JOIN u ON g.user_id = u.user_id AND g.day = u.day""")
def joi9(spark, folder):
    days = events(spark, folder).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    rules = RepairRules(key="user_id", time="day", grid_kind="date_range", num_cols=["value"])
    return rp.on_grid(days, days, rules)


@add("scl4_month_grid", """
WITH b AS (SELECT o_custkey, date_trunc('month', min(o_orderdate)) AS m, CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders GROUP BY 1),
s AS (SELECT o_custkey, CASE WHEN day(lo) = 1 THEN lo ELSE CAST(m + INTERVAL 1 MONTH AS DATE) END AS lo, hi FROM b)
SELECT o_custkey, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS o_orderdate FROM s WHERE lo <= hi""")
def scl4(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    rules = RepairRules(key="o_custkey", time="o_orderdate", grid_kind="date_range", grid_freq="MS")
    return rp.grid_points(rp.grid_spans(rp.key_bounds(orders, orders, rules), orders, rules), orders, rules)


@add("scl4_numeric_step_grid", """
WITH b AS (SELECT l_suppkey, CAST(min(l_quantity) AS BIGINT) AS lo, CAST(max(l_quantity) AS BIGINT) AS hi FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(unnest(range(lo, hi + 7, 7)) AS DOUBLE) AS l_quantity FROM b""")
def scl4_numeric(spark, folder):
    lines = table(spark, folder, "lineitem")
    rules = RepairRules(key="l_suppkey", time="l_quantity", grid_kind="numeric_step", grid_step=7)
    return rp.grid_points(rp.grid_spans(rp.key_bounds(lines, lines, rules), lines, rules), lines, rules)


@add("scl4_integer_grid", """
WITH b AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(unnest(range(lo, hi + 1, 1)) AS INTEGER) AS l_linenumber FROM b""")
def scl4_integer(spark, folder):
    lines = table(spark, folder, "lineitem")
    rules = RepairRules(key="l_orderkey", time="l_linenumber", grid_kind="integer")
    return rp.grid_points(rp.grid_spans(rp.key_bounds(lines, lines, rules), lines, rules), lines, rules)


@add("fil1_existing_dates", """SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1
  AND o_orderdate IN (SELECT o_orderdate FROM orders WHERE o_orderkey % 2 = 0)""")
def fil1(spark, folder):
    orders = table(spark, folder, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    return rp.keep_real_dates(orders.where(odd), orders.where(~odd), "o_orderdate").select("o_orderkey")


@add("fil2_boundary_trim", ctes(EV) + """
SELECT event_id FROM ev, (SELECT min(t) AS lo, max(t) AS hi FROM ev WHERE NOT syn) b WHERE syn AND t BETWEEN lo AND hi""")
def fil2(spark, folder):
    df = events(spark, folder)
    return rp.trim(df.where("is_synth"), df.where("not is_synth"), "ts").select("event_id")


@add("fil3_duration_clip", ctes(EV) + """
SELECT event_id FROM ev, (SELECT max(value) AS hi FROM ev WHERE NOT syn) b WHERE syn AND value <= hi""")
def fil3(spark, folder):
    df = events(spark, folder)
    return rp.clip_durations(df.where("is_synth"), df.where("not is_synth"), "value").select("event_id")


@add("agg7_entity_mode_mean", ctes(EV) + """, c AS (SELECT user_id, event_type, count(*) AS n FROM ev WHERE event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c)
SELECT r.user_id, event_type, round(m, 6) AS mean FROM r JOIN (SELECT user_id, avg(value) AS m FROM ev GROUP BY 1) a USING (user_id) WHERE rn = 1""")
def agg7(spark, folder):
    df = events(spark, folder)
    means = df.groupBy("user_id").agg(F.avg("value").alias("mean"))
    return modes(df, ["user_id"], "event_type").join(means, "user_id")


@add("srt1_stable_order", """SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS place FROM events""")
def srt1(spark, folder):
    rules = RepairRules(key="user_id", time="ts", row="event_id")
    sorted_rows = rp.in_order(table(spark, folder, "events").select("event_id", "user_id", "ts"), rules)
    return _places(sorted_rows)


def _places(sorted_rows):
    """Number rows by where they stand: by partition, then by position in it."""
    stood = sorted_rows.withColumn("_at", F.monotonically_increasing_id())
    return ordered(stood, [], ["_at"]).numbered("place").result().select("event_id", "user_id", "place")


@add("srt1_row_index_order", """SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, event_id % 97, event_id) - 1 AS place FROM events""")
def srt1_row_index(spark, folder):
    rules = RepairRules(key="user_id", time="ts", row="event_id", row_index="step")
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 97).alias("step"))
    return _places(rp.in_order(rows, rules))
