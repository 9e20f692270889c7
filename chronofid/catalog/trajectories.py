"""Longitudinal scores and panel fills over ``events`` by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog import sections as sec
from chronofid.catalog.base import EV, EVENT_ROLES, Catalogue, ctes, events, ks_cte
from chronofid.operators import fill
from chronofid.operators.spectra import (
    HASH_A, HASH_B, HASH_C, HASH_MOD, HASH_SECOND, channel_moments, differences, joint_minmax, scale_channels,
)
from chronofid.plans import panel
from chronofid.plans import trajectories as tr
from chronofid.plans.metrics import Scan, evaluate
from chronofid.plans.roles import TableRoles

CATALOGUE = Catalogue()
add = CATALOGUE.add

DAILY_ROLES = TableRoles(
    key="user_id", time="day", row="row_ix", num_cols=["value", "k"], cat_cols=["event_type"]
)
#: The lag up to which the queries look: an eighth of the median real trajectory, as the data has it.
LAGS = """lags AS (SELECT greatest(1, floor(floor(median(n)) / 8)) AS most FROM (SELECT user_id, count(*) AS n FROM daily WHERE NOT syn GROUP BY 1) q)"""
RAYS = tr.PROJECTIONS

DAILY = """daily AS (
  SELECT syn, user_id, day, sum(value) AS value, sum(k) AS k, arg_min(event_type, event_id) AS event_type,
         min(event_id) AS row_ix FROM ev GROUP BY 1, 2, 3)"""
LONG = "long AS (SELECT syn, user_id, day, 'value' AS feature, value FROM daily UNION ALL SELECT syn, user_id, day, 'k', k FROM daily)"


def daily(spark, folder):
    """One row per user and day: sums, and the day's first event type. Users skip days, which leaves gaps."""
    day = F.to_date("ts").alias("day")
    return events(spark, folder).groupBy("is_synth", "user_id", day).agg(
        F.sum("value").alias("value"),
        F.sum("k").alias("k"),
        F.min_by("event_type", "event_id").alias("event_type"),
        F.min("event_id").alias("row_ix"),
    )


def max_lag(df):
    return tr.default_max_lag(df, DAILY_ROLES).first()["max_lag"]


def daily_typed(spark, folder):
    """The first event of each type per user and day, so that a day can hold several rows."""
    day = F.to_date("ts").alias("day")
    return events(spark, folder).groupBy("is_synth", "user_id", day, "event_type").agg(
        F.sum("value").alias("value"), F.sum("k").alias("k"), F.min("event_id").alias("row_ix")
    )


DIFFS = """diffs AS (SELECT syn, feature, value - lag(value) OVER (PARTITION BY feature, syn, user_id ORDER BY t, event_id) AS d
  FROM (SELECT syn, user_id, t, event_id, 'value' AS feature, value FROM ev UNION ALL SELECT syn, user_id, t, event_id, 'k', k FROM ev) q
  WHERE value IS NOT NULL),
dd AS (SELECT * FROM diffs WHERE d IS NOT NULL)"""


@add("l1_first_difference_ks", ctes(EV, DIFFS, ks_cte("x", "dd", "feature", "d")) + """
SELECT feature, round(1 - ks, 6) AS score FROM x""")
def l1(spark, folder):
    return tr.first_difference_ks(events(spark, folder), EVENT_ROLES)


@add("win3_first_difference", ctes(EV, DAILY) + """, q AS (
  SELECT syn AS is_synth, user_id, day, value - lag(value) OVER (PARTITION BY syn, user_id ORDER BY day) AS diff,
         row_number() OVER (PARTITION BY syn, user_id ORDER BY day) - 2 AS ix FROM daily)
SELECT is_synth, user_id, day, round(diff, 6) AS diff, ix FROM q WHERE diff IS NOT NULL""")
def win3(spark, folder):
    df = daily(spark, folder)
    steps = differences(df, ["is_synth", "user_id"], ["day"], "value")
    return steps.select("is_synth", "user_id", "day", F.col("value").alias("diff"), "ix")


MOVES = """steps AS (
  SELECT syn, user_id, day, event_type AS a, lead(event_type) OVER w AS b, lead(day) OVER w AS next_day
  FROM daily WINDOW w AS (PARTITION BY syn, user_id ORDER BY day)),
grid AS (SELECT day, lead(day) OVER (ORDER BY day) AS expected FROM (SELECT DISTINCT day FROM daily WHERE NOT syn) q),
adj AS (SELECT s.* FROM steps s JOIN grid g ON s.day = g.day AND s.next_day = g.expected),
cell AS (SELECT day, a, b, CAST(count(*) FILTER (NOT syn) AS DOUBLE) AS r, CAST(count(*) FILTER (syn) AS DOUBLE) AS s FROM adj GROUP BY 1, 2, 3),
share AS (SELECT *, coalesce(r / nullif(sum(r) OVER (PARTITION BY day, a), 0), 0) AS p,
                 coalesce(s / nullif(sum(s) OVER (PARTITION BY day, a), 0), 0) AS q FROM cell)"""


@add("win4_next_step", ctes(EV, DAILY, MOVES) + """
SELECT syn AS is_synth, user_id, day, a AS event_type, b AS next_type, next_day FROM steps""")
def win4(spark, folder):
    steps = tr.next_steps(daily(spark, folder), DAILY_ROLES)
    return steps.select("is_synth", "user_id", "day", F.col("value").alias("event_type"),
                        F.col("next_value").alias("next_type"), F.col("next_time").alias("next_day"))


@add("win11_transition_shares", ctes(EV, DAILY, MOVES) + """
SELECT day, a AS from_type, b AS to_type, round(p, 6) AS real_share, round(q, 6) AS synth_share FROM share""")
def win11(spark, folder):
    shares = tr.transition_shares(daily(spark, folder), DAILY_ROLES)
    return shares.select("day", F.col("value").alias("from_type"), F.col("next_value").alias("to_type"), "real_share", "synth_share")


L2 = """, per AS (SELECT day, sum(abs(p - q)) AS gap, sum(r) AS r, sum(s) AS s FROM share GROUP BY 1),
cats AS (SELECT count(*) AS c FROM (SELECT a FROM cell UNION SELECT b FROM cell) q)
"""


@add("l2_transition_tvd", ctes(EV, DAILY, MOVES) + L2 + """
SELECT 'event_type' AS feature, round(avg(1 - gap / (2 * c)), 6) AS score FROM per, cats WHERE r > 0 AND s > 0""")
def l2(spark, folder):
    return tr.transition_similarity(daily(spark, folder), DAILY_ROLES)


@add("joi13_outer_alignment", ctes(EV, DAILY, MOVES) + """
SELECT day, a AS from_type, b AS to_type, CAST(r AS BIGINT) AS r, CAST(s AS BIGINT) AS s FROM cell""")
def joi13(spark, folder):
    shares = tr.transition_shares(daily(spark, folder), DAILY_ROLES)
    return shares.select("day", F.col("value").alias("from_type"), F.col("next_value").alias("to_type"), "r", "s")


ACF = LAGS + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY feature, syn, user_id ORDER BY day) AS i FROM long WHERE value IS NOT NULL),
m AS (SELECT feature, syn, user_id, count(*) AS n, avg(value) AS mean, var_pop(value) AS var FROM pos GROUP BY 1, 2, 3 HAVING count(*) > (SELECT most FROM lags)),
acf AS (SELECT a.feature, a.syn, a.user_id, b.i - a.i AS lag,
    CASE WHEN any_value(var) = 0 THEN 0 ELSE avg((a.value - mean) * (b.value - mean)) / any_value(var) END AS acf
  FROM pos a JOIN m ON a.feature = m.feature AND a.syn = m.syn AND a.user_id = m.user_id
  JOIN pos b ON a.feature = b.feature AND a.syn = b.syn AND a.user_id = b.user_id AND b.i > a.i AND b.i <= a.i + (SELECT most FROM lags)
  GROUP BY 1, 2, 3, 4),
side AS (SELECT feature, syn, lag, avg(acf) AS acf FROM acf GROUP BY 1, 2, 3),
sides AS (SELECT feature, lag, max(acf) FILTER (NOT syn) AS r, max(acf) FILTER (syn) AS s FROM side GROUP BY 1, 2)"""
S_ACF = "SELECT feature, round(1 - avg(abs(r - s)) / 2, 6) AS score FROM sides GROUP BY 1"
DEP_LONG = """long AS (SELECT feature, syn, 0 AS user_id, day, avg(value) AS value FROM (
  SELECT syn, user_id, day, 'value' AS feature, value FROM daily UNION ALL SELECT syn, user_id, day, 'k', k FROM daily) q GROUP BY 1, 2, 4)"""


@add("win9_lagged_products", ctes(EV, DAILY, LONG, ACF) + """
SELECT feature, syn AS is_synth, user_id, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf FROM acf""")
def win9(spark, folder):
    df = daily(spark, folder)
    long = df.unpivot(["is_synth", "user_id", "day"], ["value", "k"], "feature", "value")
    return tr.autocorrelation(long, ["feature", "is_synth", "user_id"], ["day"], "value", max_lag(df))


@add("l3_autocorrelation_independent", ctes(EV, DAILY, LONG, ACF) + S_ACF)
def l3(spark, folder):
    df = daily(spark, folder)
    return tr.autocorrelation_similarity(df, DAILY_ROLES, max_lag(df))


@add("l3_autocorrelation_dependent", ctes(EV, DAILY, DEP_LONG, ACF) + S_ACF)
def l3_dependent(spark, folder):
    from dataclasses import replace

    df = daily(spark, folder)
    return tr.autocorrelation_similarity(df, replace(DAILY_ROLES, independence="dependent"), max_lag(df))


@add("agg6_macro_trajectory", ctes(EV, DAILY) + """
SELECT syn AS is_synth, day, round(avg(value), 6) AS value FROM daily GROUP BY 1, 2""")
def agg6(spark, folder):
    return daily(spark, folder).groupBy("is_synth", "day").agg(F.avg("value").alias("value"))


@add("l4_default_max_lag", ctes(EV) + """
SELECT CAST(greatest(1, floor(floor(median(n)) / 8)) AS BIGINT) AS max_lag
FROM (SELECT user_id, count(*) AS n FROM ev WHERE NOT syn GROUP BY 1) q""")
def l4(spark, folder):
    return tr.default_max_lag(events(spark, folder), EVENT_ROLES)


@add("l4_diagnostics", ctes(EV, DAILY, LONG, LAGS) + """, n AS (SELECT feature, syn, user_id, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2, 3)
SELECT feature, syn AS is_synth, count(*) AS flows, count(*) FILTER (n > (SELECT most FROM lags)) AS valid_flows, max(n) AS max_length,
       round(median(n), 6) AS median_length, count(*) FILTER (n > (SELECT most FROM lags)) > 0 AS can_compute FROM n GROUP BY 1, 2""")
def l4_diagnostics(spark, folder):
    df = daily(spark, folder)
    return tr.autocorrelation_diagnostics(df, DAILY_ROLES, max_lag(df))


GRID = """times AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS time_ix FROM (SELECT DISTINCT day FROM src WHERE NOT syn) q),
ent AS (SELECT DISTINCT syn, user_id FROM src),
uniq AS (SELECT syn, user_id, day, arg_min(value, row_ix) AS value, arg_min(k, row_ix) AS k FROM src GROUP BY 1, 2, 3),
g AS (SELECT e.syn, e.user_id, t.time_ix, t.day, u.value, u.k FROM ent e CROSS JOIN times t
  LEFT JOIN uniq u ON u.syn = e.syn AND u.user_id = e.user_id AND u.day = t.day)"""
SRC = "src AS (SELECT * FROM daily)"
SRC_TYPED = "src AS (SELECT syn, user_id, day, event_type, sum(value) AS value, sum(k) AS k, min(event_id) AS row_ix FROM ev GROUP BY 1, 2, 3, 4)"
KNOWN = ", known AS (SELECT *, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER p AS f_{c}, first_value({c} IGNORE NULLS) OVER n AS b_{c}, "
    f"last_value(CASE WHEN {c} IS NOT NULL THEN epoch(CAST(day AS TIMESTAMP)) END IGNORE NULLS) OVER p AS ft_{c}, "
    f"first_value(CASE WHEN {c} IS NOT NULL THEN epoch(CAST(day AS TIMESTAMP)) END IGNORE NULLS) OVER n AS bt_{c}"
    for c in ("value", "k")) + """ FROM g WINDOW p AS (PARTITION BY syn, user_id ORDER BY time_ix ROWS UNBOUNDED PRECEDING),
  n AS (PARTITION BY syn, user_id ORDER BY time_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""
FILL_SQL = {
    "edge_nearest": "CASE WHEN f_{c} IS NULL THEN b_{c} WHEN b_{c} IS NULL THEN f_{c} ELSE {c} END",
    "ffill": "coalesce(f_{c}, b_{c})",
    "interpolate": "CASE WHEN {c} IS NOT NULL THEN {c} WHEN f_{c} IS NULL THEN b_{c} WHEN b_{c} IS NULL THEN f_{c} "
                   "ELSE f_{c} + (b_{c} - f_{c}) / (bt_{c} - ft_{c}) * (epoch(CAST(day AS TIMESTAMP)) - ft_{c}) END",
    "tsmean": "coalesce({c}, avg({c}) OVER (PARTITION BY syn, time_ix))",
    "entitymean": "coalesce({c}, avg({c}) OVER (PARTITION BY syn, user_id))",
    "zero": "{c}",
}


def panel_sql(method, src=SRC):
    cell = FILL_SQL[method]
    return ctes(EV, DAILY, src, GRID) + KNOWN + "SELECT syn AS is_synth, user_id, time_ix, " + ", ".join(
        f"round(coalesce({cell.format(c=c)}, 0), 6) AS {c}" for c in ("value", "k")) + " FROM known"


def _panel(method):
    @add(f"l5_panel_{method}", panel_sql(method))
    def query(spark, folder):
        return panel.align(daily(spark, folder), DAILY_ROLES, method)


for _method in FILL_SQL:
    _panel(_method)


@add("l5_panel_duplicates", panel_sql("ffill", SRC_TYPED))
def l5_duplicates(spark, folder):
    return panel.align(daily_typed(spark, folder), DAILY_ROLES, "edge_nearest")


@add("win5_carry_forward", ctes(EV, DAILY, SRC, GRID) + KNOWN + """
SELECT syn AS is_synth, user_id, time_ix, round(f_value, 6) AS forward, round(coalesce(f_value, b_value), 6) AS both_ways,
  round(CASE WHEN f_value IS NULL THEN b_value WHEN b_value IS NULL THEN f_value ELSE value END, 6) AS edges FROM known""")
def win5(spark, folder):
    grid = panel.align(daily(spark, folder), DAILY_ROLES, "none")
    grid = grid.select("is_synth", "user_id", "time_ix", *[F.col("value").alias(c) for c in ("forward", "both_ways", "edges")])
    keys, order = ["is_synth", "user_id"], ["time_ix"]
    out = fill.carry_forward(grid, keys, order, ["forward"])
    return fill.carry_edges(fill.carry_both(out, keys, order, ["both_ways"]), keys, order, ["edges"])


POSITIONS = """, placed AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN time_ix END IGNORE NULLS) OVER p AS fi,
    first_value(CASE WHEN value IS NOT NULL THEN time_ix END IGNORE NULLS) OVER n AS bi
  FROM known WINDOW p AS (PARTITION BY syn, user_id ORDER BY time_ix ROWS UNBOUNDED PRECEDING),
  n AS (PARTITION BY syn, user_id ORDER BY time_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@add("win6_interpolate", ctes(EV, DAILY, SRC, GRID) + KNOWN + POSITIONS + """
SELECT syn AS is_synth, user_id, time_ix, round(CASE WHEN value IS NOT NULL THEN value WHEN f_value IS NULL THEN b_value
  WHEN b_value IS NULL THEN f_value ELSE f_value + (b_value - f_value) / (bi - fi) * (time_ix - fi) END, 6) AS value FROM placed""")
def win6(spark, folder):
    grid = panel.align(daily(spark, folder), DAILY_ROLES, "none").drop("k")
    return fill.interpolate(grid, ["is_synth", "user_id"], ["time_ix"], ["value"])


@add("win7_group_mean_fill", ctes(EV, DAILY, SRC, GRID) + """
SELECT syn AS is_synth, user_id, time_ix, round(coalesce(value, avg(value) OVER (PARTITION BY syn, time_ix)), 6) AS value,
       round(coalesce(k, avg(k) OVER (PARTITION BY syn, user_id)), 6) AS k FROM g""")
def win7(spark, folder):
    grid = panel.align(daily(spark, folder), DAILY_ROLES, "none")
    return fill.fill_group_mean(fill.fill_group_mean(grid, ["is_synth", "time_ix"], ["value"]), ["is_synth", "user_id"], ["k"])


Z = """pan AS (SELECT syn, user_id, time_ix, 'value' AS channel, 0 AS c, {value} AS x FROM known
  UNION ALL SELECT syn, user_id, time_ix, 'k', 1, {k} FROM known),
z AS (SELECT p.syn, p.user_id, p.time_ix, p.channel, p.c, (x - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS x
  FROM pan p JOIN (SELECT channel, avg(x) AS mu, stddev_pop(x) AS sd FROM pan WHERE NOT syn GROUP BY 1) m ON p.channel = m.channel)""".format(
    **{c: "coalesce(" + FILL_SQL["edge_nearest"].format(c=c) + ", 0)" for c in ("value", "k")})
SPEC = """dif AS (SELECT syn, user_id, channel, c, time_ix - 1 AS ix, x - lag(x) OVER (PARTITION BY syn, user_id, channel ORDER BY time_ix) AS d FROM z),
len AS (SELECT count(*) - 1 AS n, (count(*) - 1) // 2 + 1 AS bins FROM times),
fr AS (SELECT unnest(range(0, bins)) AS freq, n, bins FROM len),
mags AS (SELECT syn, user_id, channel, c, freq, c * bins + freq AS dim,
    sqrt(pow(sum(d * cos(2 * pi() * ((freq * ix) % n) / n)), 2) + pow(sum(d * sin(2 * pi() * ((freq * ix) % n) / n)), 2)) AS mag
  FROM dif, fr WHERE d IS NOT NULL GROUP BY syn, user_id, channel, c, freq, bins),
spec AS (SELECT syn, user_id, channel, freq, dim, mag / greatest(sum(mag) OVER (PARTITION BY syn, user_id), 1e-12) AS mag FROM mags)"""
SPECTRUM = ctes(EV, DAILY, SRC, GRID) + KNOWN + ", " + Z + ", " + SPEC


@add("l6_spectrum", SPECTRUM + """
SELECT syn AS is_synth, user_id, channel, freq, dim, round(mag, 6) AS mag FROM spec""")
def l6(spark, folder):
    return tr.spectrum(daily(spark, folder), DAILY_ROLES)


@add("l6_spectrum_power_mean", SPECTRUM + """, pw AS (SELECT syn, user_id, freq, avg(mag * mag) AS mag FROM mags GROUP BY 1, 2, 3)
SELECT syn AS is_synth, user_id, '*' AS channel, freq, freq AS dim,
       round(mag / greatest(sum(mag) OVER (PARTITION BY syn, user_id), 1e-12), 6) AS mag FROM pw""")
def l6_power(spark, folder):
    return tr.spectrum(daily(spark, folder), DAILY_ROLES, feature_type="power", reduce="mean")


def _unit(shift):
    r, d = f"(ray + 1 + {shift})", "(dim + 1)"
    mixed = f"(({r} * {r}) % {HASH_MOD}) * {HASH_A} + (({d} * {d}) % {HASH_MOD}) * {HASH_B} + (({r} * {d}) % {HASH_MOD}) * {HASH_C}"
    return f"((({mixed}) % {HASH_MOD}) + 0.5) / {HASH_MOD}"


SLICED = f""", rays AS (SELECT unnest(range(0, {RAYS})) AS ray),
dirs AS (SELECT ray, dim, sqrt(-2 * ln({_unit(0)})) * cos(2 * pi() * {_unit(HASH_SECOND)}) AS th
  FROM rays, (SELECT DISTINCT dim FROM spec) q),
feats AS (SELECT syn, user_id, '*' AS feature, dim, mag FROM spec UNION ALL SELECT syn, user_id, channel, dim, mag FROM spec),
proj AS (SELECT syn, user_id, feature, ray, sum(mag * th) / sqrt(sum(th * th)) AS v FROM feats JOIN dirs USING (dim) GROUP BY 1, 2, 3, 4),
{ks_cte('pw', 'proj', 'feature, ray', 'v')},
dist AS (SELECT feature, avg(w1) AS distance FROM pw GROUP BY 1)
"""


@add("l7_sliced_tt_wasserstein", SPECTRUM + SLICED + """
SELECT feature, round(distance, 6) AS distance, round(CASE WHEN feature <> '*' THEN distance / sum(distance) FILTER (feature <> '*') OVER () END, 6) AS contribution,
  CASE WHEN feature <> '*' THEN row_number() OVER (PARTITION BY feature <> '*' ORDER BY distance DESC, feature) END AS rank FROM dist""")
def l7(spark, folder):
    return tr.sliced_tt_wasserstein(daily(spark, folder), DAILY_ROLES, projections=RAYS)


@add("srt2_contribution_rank", SPECTRUM + SLICED + """
SELECT feature, row_number() OVER (ORDER BY distance DESC, feature) AS rank FROM dist WHERE feature <> '*'""")
def srt2(spark, folder):
    return l7(spark, folder).where(F.col("feature") != "*").select("feature", "rank")


L8_SQL = (SPECTRUM + SLICED.replace(f"range(0, {RAYS})", f"range(0, {tr.PROJECTIONS})") + ", " + ", ".join([
    LONG, MOVES, ACF, """dd AS (SELECT * FROM (SELECT syn, feature, value - lag(value) OVER (PARTITION BY feature, syn, user_id ORDER BY day) AS d FROM long) q
  WHERE d IS NOT NULL)""", ks_cte("fd", "dd", "feature", "d")]) + L2 + f"""
SELECT 'FirstDifferenceKSComplement' AS metric, feature, round(1 - ks, 6) AS score FROM fd
UNION ALL SELECT 'AutoCorrelationSimilarity', * FROM ({S_ACF}) q
UNION ALL SELECT 'SlicedTTWasserstein', feature, round(distance, 6) FROM dist
UNION ALL SELECT 'TransitionMatrixTVDComplement', 'event_type', round(avg(1 - gap / (2 * c)), 6) FROM per, cats WHERE r > 0 AND s > 0""")


@add("l8_longitudinal_suite", L8_SQL)
def l8(spark, folder):
    return tr.suite(daily(spark, folder), DAILY_ROLES)


#: Cross-sections of the daily table: what ``catalog.sections`` has for single events, with one category column.
DAILY_D = "d AS (SELECT * FROM daily)"
DAILY_CAT = "cat AS (SELECT syn, day, 'event_type' AS feature, event_type AS value FROM d)"


@add("met1_two_families", "SELECT 'trajectories' AS family, * FROM (" + L8_SQL + """) t
UNION ALL SELECT 'sections', * FROM (""" + ctes(EV, DAILY, DAILY_D, sec.NUM, DAILY_CAT, sec.KS, sec.TV, sec.STAT, sec.NP, sec.RHO, sec.BOUNDS, sec.SEEN)
     + "\nUNION ALL ".join(f"SELECT '{m}' AS metric, feature, score FROM ({q}) q" for m, q in sec.S.items() if m != "CS-ContingencySim") + ") s")
def met1(spark, folder):
    """Longitudinal and cross-sectional scores of one table, which is read once for all of them."""
    return evaluate(Scan(daily(spark, folder), DAILY_ROLES), ["trajectories", "sections"])


@add("agg11_channel_zscore", ctes(EV, DAILY, LONG) + """, m AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM long WHERE NOT syn GROUP BY 1)
SELECT syn AS is_synth, user_id, day, feature, round((value - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS value FROM long JOIN m USING (feature)""")
def agg11(spark, folder):
    df = daily(spark, folder).unpivot(["is_synth", "user_id", "day"], ["value", "k"], "feature", "value")
    return scale_channels(df, ["feature"], "value", channel_moments(df.where("not is_synth"), ["feature"], "value"), None)


@add("agg12_joint_minmax", ctes(EV, DAILY, LONG) + """, b AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1)
SELECT syn AS is_synth, user_id, day, feature, round((value - lo) / (hi - lo + 1e-8), 6) AS value FROM long JOIN b USING (feature)""")
def agg12(spark, folder):
    df = daily(spark, folder).unpivot(["is_synth", "user_id", "day"], ["value", "k"], "feature", "value")
    return joint_minmax(df, ["feature"], "value").select("is_synth", "user_id", "day", "feature", "value")
