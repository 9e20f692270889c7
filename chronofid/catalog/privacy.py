"""Privacy scores over ``embeddings`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofid.catalog.base import EV, EVENT_ROLES, Catalogue, ctes, events, sided, table
from chronofid.functions.labels import right_closed_bin, token
from chronofid.functions.vectors import l1_distance, l2_distance, squared_distance
from chronofid.operators import knn
from chronofid.plans import embedding, privacy
from chronofid.plans.roles import TableRoles
from chronofid.session import checkpointed

CATALOGUE = Catalogue()
add = CATALOGUE.add

DAY_ROLES = EVENT_ROLES
FLOW_ROLES = TableRoles(key="flow", time="ts", row="event_id", num_cols=["value", "k"])

EMB = """emb AS (SELECT vec_id, vec_id % 2 = 1 AS syn, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
NN = """d AS (SELECT r.vec_id AS id, list_distance(r.v, s.v) AS d FROM emb r, emb s WHERE NOT r.syn AND s.syn),
nn AS (SELECT id, min(d) AS d1, list_sort(list(d))[2] AS d2 FROM d GROUP BY 1)"""
DAY_NN = """pts AS (SELECT event_id, syn, day, value, k FROM ev WHERE value IS NOT NULL AND k IS NOT NULL),
d AS (SELECT r.event_id AS id, r.day, sqrt(pow(r.value - s.value, 2) + pow(r.k - s.k, 2)) AS d FROM pts r JOIN pts s ON r.day = s.day WHERE NOT r.syn AND s.syn),
nn AS (SELECT id, day, min(d) AS d1, list_sort(list(d))[2] AS d2 FROM d GROUP BY 1, 2)"""
DCR = "SELECT round(median(d1), 6) AS median, round(avg(d1), 6) AS mean, count(*) AS n_rows FROM nn"
NNDR = """SELECT round(median(d1 / d2) FILTER (d2 > 1e-12), 6) AS median, round(avg(d1 / d2) FILTER (d2 > 1e-12), 6) AS mean,
  round(min(d1 / d2) FILTER (d2 > 1e-12), 6) AS min, round(max(d1 / d2) FILTER (d2 > 1e-12), 6) AS max,
  count(*) FILTER (d2 <= 1e-12) AS n_excluded FROM nn WHERE d2 IS NOT NULL"""
CS = """SELECT round(avg(m), 6) AS mean_over_time, count(m) AS n_times, round(median(m), 6) AS median_over_time FROM ({}) q"""
CS_DCR = CS.format("SELECT day, median(d1) AS m FROM nn GROUP BY 1")
CS_NNDR = CS.format("SELECT day, median(d1 / d2) AS m FROM nn WHERE d2 > 1e-12 GROUP BY 1")


def vectors(spark, folder):
    return sided(spark, folder, "embeddings", "vec_id").withColumn("vec", F.col("embedding").cast("array<double>"))


def points(spark, folder):
    return privacy.with_vector(events(spark, folder), ["value", "k"])


@add("v1_dcr", ctes(EMB, NN) + DCR)
def v1(spark, folder):
    return privacy.closest_record(vectors(spark, folder))


@add("v2_nndr", ctes(EMB, NN) + NNDR)
def v2(spark, folder):
    return privacy.neighbour_ratio(vectors(spark, folder))


@add("v3_cs_dcr", ctes(EV, DAY_NN) + CS_DCR)
def v3(spark, folder):
    return privacy.sectional_closest_record(points(spark, folder), DAY_ROLES)


@add("v4_cs_nndr", ctes(EV, DAY_NN) + CS_NNDR)
def v4(spark, folder):
    return privacy.sectional_neighbour_ratio(points(spark, folder), DAY_ROLES)


@add("joi10_knn_join", ctes(EMB, NN) + """SELECT id AS vec_id, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM nn""")
def joi10(spark, folder):
    df = vectors(spark, folder)
    found = knn.distances(df, None, "vec", 2)
    ids = df.where("not is_synth").select("vec_id", "vec")
    return ids.join(found, "vec").select("vec_id", F.element_at("best", 1).alias("d1"), F.element_at("best", 2).alias("d2"))


@add("joi11_knn_join_by_time", ctes(EV, DAY_NN) + """SELECT id AS event_id, day AS ts, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM nn""")
def joi11(spark, folder):
    df = privacy.whole_days(points(spark, folder), "ts")
    found = knn.distances(df, "ts", "vec", 2)
    ids = df.where("not is_synth").select("event_id", "ts", "vec")
    joined = ids.join(found, ["ts", "vec"]).where(F.size("best") > 0)
    return joined.select(
        "event_id", "ts", F.element_at("best", 1).alias("d1"), F.try_element_at("best", F.lit(2)).alias("d2")
    )


SPAN = """span AS (SELECT min(value) AS vlo, max(value) AS vhi, min(k) AS klo, max(k) AS khi FROM ev WHERE NOT syn AND (value IS NOT NULL OR k IS NOT NULL))"""


def _bin(c, x):
    return " + ".join(f"CAST({x} > {c}lo + {i} * ({c}hi - {c}lo) / 10 AS INTEGER)" for i in range(1, 10))


TOK = f"""tok AS (SELECT syn, user_id, t, event_id, concat_ws('|', coalesce(CAST({_bin('v', 'value')} AS VARCHAR), '__NA__'),
    coalesce(CAST({_bin('k', 'k')} AS VARCHAR), '__NA__'), coalesce(event_type, '__NA__')) AS g FROM ev, span)"""


def _grams(n):
    leads = ", ".join(f"lead(g, {i}) OVER w AS g{i}" for i in range(1, n))
    names = ", ".join(["g"] + [f"g{i}" for i in range(1, n)])
    last = "g" if n == 1 else f"g{n - 1}"
    return f"""grams{n} AS (SELECT syn, user_id, concat_ws('#', {names}) AS gram FROM (
    SELECT syn, user_id, g, row_number() OVER w AS pos{', ' + leads if leads else ''} FROM tok WINDOW w AS (PARTITION BY syn, user_id ORDER BY t, event_id)) q
  WHERE {last} IS NOT NULL OR pos = 1),
expo{n} AS (SELECT user_id, count(*) AS total, count(*) FILTER (gram IN (SELECT gram FROM grams{n} WHERE NOT syn)) AS matched FROM grams{n} WHERE syn GROUP BY 1)"""


def _expo(n):
    return f"""SELECT round(avg(CAST(matched AS DOUBLE) / total), 6) AS score, round(CAST(sum(matched) AS DOUBLE) / sum(total), 6) AS micro_score, count(*) AS n_entities,
  CAST(sum(matched) AS BIGINT) AS matched_total, CAST(sum(total) AS BIGINT) AS ngrams_total, round(median(CAST(matched AS DOUBLE) / total), 6) AS median_exposure FROM expo{n}"""


@add("v5_ngram_exposure_1", ctes(EV, SPAN, TOK, _grams(1)) + _expo(1))
def v5_1(spark, folder):
    return privacy.ngram_exposure(events(spark, folder), EVENT_ROLES, 1)


@add("v5_ngram_exposure_3", ctes(EV, SPAN, TOK, _grams(3)) + _expo(3))
def v5_3(spark, folder):
    return privacy.ngram_exposure(events(spark, folder), EVENT_ROLES, 3)


@add("joi12_ngram_membership", ctes(EV, SPAN, TOK, _grams(3)) + "SELECT user_id, total, matched FROM expo3")
def joi12(spark, folder):
    return privacy.exposures(events(spark, folder), EVENT_ROLES, 3)


@add("win8_ngrams", ctes(EV, SPAN, TOK, _grams(3)) + """
SELECT syn AS is_synth, user_id, gram FROM grams3""")
def win8(spark, folder):
    df = events(spark, folder)
    edges = privacy.bin_edges(df.where("not is_synth"), ["value", "k"])
    grams = privacy.ngrams(df, EVENT_ROLES, 3, edges)
    text = F.array_join(F.transform("gram", lambda g: F.array_join(g, "|")), "#")
    return grams.select("is_synth", "user_id", text.alias("gram"))


@add("agg10_bin_edges", ctes(EV, SPAN) + """
SELECT 'value' AS feature, i AS edge_no, round(vlo + i * (vhi - vlo) / 10, 6) AS edge FROM span, (SELECT unnest(range(1, 10)) AS i) q
UNION ALL SELECT 'k', i, round(klo + i * (khi - klo) / 10, 6) FROM span, (SELECT unnest(range(1, 10)) AS i) q""")
def agg10(spark, folder):
    edges = privacy.bin_edges(events(spark, folder).where("not is_synth"), ["value", "k"])
    rows = [(c, i + 1, e) for c, es in edges.items() for i, e in enumerate(es)]
    return spark.createDataFrame(rows, "feature string, edge_no long, edge double")


@add("scl5_right_closed_bins", ctes(EV, SPAN) + f"SELECT event_id, {_bin('v', 'value')} AS bin FROM ev, span")
def scl5(spark, folder):
    df = events(spark, folder)
    edges = privacy.bin_edges(df.where("not is_synth"), ["value"])
    return df.select("event_id", right_closed_bin("value", edges["value"]).alias("bin"))


@add("scl6_value_tokens", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, CAST(l_linenumber AS VARCHAR) AS line,
       CASE WHEN l_returnflag = 'N' THEN '__NA__' ELSE l_returnflag END AS flag FROM lineitem""")
def scl6(spark, folder):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", token("l_quantity").alias("quantity"),
        token("l_linenumber").alias("line"), token(flag).alias("flag"),
    )


@add("fil4_known_rows", """
WITH m AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, quality, toxic FROM m WHERE quality IS NOT NULL OR toxic IS NOT NULL""")
def fil4(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left")
    return privacy.known_rows(joined.select("doc_id", "quality", "toxic"), ["quality", "toxic"])


def _stat(metric, names, sql):
    return "\nUNION ALL ".join(f"SELECT '{metric}' AS metric, '{n}' AS feature, {n} AS score FROM ({sql}) q" for n in names)


ALL_NN = """gd AS (SELECT r.event_id AS id, sqrt(pow(r.value - s.value, 2) + pow(r.k - s.k, 2)) AS d FROM pts r, pts s WHERE NOT r.syn AND s.syn),
gnn AS (SELECT id, list_min(m) AS d1, list_sort(m)[2] AS d2 FROM (SELECT id, min(d, 2) AS m FROM gd GROUP BY 1) q)"""


@add("v8_privacy_suite", ctes(EV, DAY_NN, ALL_NN, SPAN, TOK, _grams(1), _grams(3)) + "\nUNION ALL ".join([
    _stat("DCR", ["median", "mean"], DCR.replace("FROM nn", "FROM gnn")),
    _stat("NNDR", ["median", "mean", "min", "max"], NNDR.replace("FROM nn", "FROM gnn")),
    _stat("CS-DCR", ["mean_over_time", "median_over_time"], CS_DCR),
    _stat("CS-NNDR", ["mean_over_time", "median_over_time"], CS_NNDR),
    _stat("NGramExposure-1", ["score", "micro_score", "median_exposure"], _expo(1)),
    _stat("NGramExposure-3", ["score", "micro_score", "median_exposure"], _expo(3))]))
def v8(spark, folder):
    return privacy.suite(events(spark, folder), EVENT_ROLES)


FLOW = """fl AS (SELECT user_id * 2 + CAST(syn AS INTEGER) AS flow, syn, t, event_id, value, k FROM ev),
lg AS (SELECT flow, syn, t, event_id, 'value' AS channel, 0 AS c, value AS x FROM fl UNION ALL SELECT flow, syn, t, event_id, 'k', 1, k FROM fl),
ok AS (SELECT flow, count(*) AS n FROM fl GROUP BY 1 HAVING count(*) >= 2 AND count(value) = count(*) AND count(k) = count(*))"""


def _phi(scaled):
    return f"""sc AS ({scaled}),
df AS (SELECT flow, channel, c, n, x - lag(x) OVER (PARTITION BY flow, channel ORDER BY t, event_id) AS d,
    row_number() OVER (PARTITION BY flow, channel ORDER BY t, event_id) - 2 AS ix FROM sc),
phi AS (SELECT flow, channel, freq, c * 8 + freq AS dim,
    sqrt(pow(sum(d * cos(2 * pi() * ((freq * ix) % greatest(n - 1, 8)) / greatest(n - 1, 8))), 2)
       + pow(sum(d * sin(2 * pi() * ((freq * ix) % greatest(n - 1, 8)) / greatest(n - 1, 8))), 2)) AS mag
  FROM df, (SELECT unnest(range(0, 8)) AS freq) f WHERE d IS NOT NULL GROUP BY flow, channel, c, freq)"""


OWN = _phi("""SELECT flow, t, event_id, channel, c, n, (x - avg(x) OVER p) / (stddev_pop(x) OVER p + 1e-8) AS x
  FROM lg JOIN ok USING (flow) WINDOW p AS (PARTITION BY flow, channel)""")
JOINT = _phi("""SELECT flow, t, event_id, channel, c, n, (x - mu) / (sd + 1e-8) AS x FROM lg JOIN ok USING (flow)
  JOIN (SELECT channel, avg(x) AS mu, stddev_pop(x) AS sd FROM lg GROUP BY 1) m USING (channel)""")


def flows(spark, folder):
    return events(spark, folder).withColumn("flow", F.col("user_id") * 2 + F.col("is_synth").cast("int"))


@add("v6_spectral_embedding", ctes(EV, FLOW, OWN) + "SELECT flow, channel, freq, dim, round(mag, 6) AS mag FROM phi")
def v6(spark, folder):
    return embedding.magnitudes(flows(spark, folder), FLOW_ROLES, on_nan="skip")


@add("v6_spectral_embedding_joint", ctes(EV, FLOW, JOINT) + "SELECT flow, channel, freq, dim, round(mag, 6) AS mag FROM phi")
def v6_joint(spark, folder):
    df = flows(spark, folder)
    return embedding.magnitudes(df, FLOW_ROLES, on_nan="skip", moments=embedding.joint_moments(df, FLOW_ROLES.num_cols))


@add("v6_embedding_report", ctes(EV, FLOW) + """, s AS (SELECT flow, count(*) AS n, count(*) > count(value) OR count(*) > count(k) AS bad FROM fl GROUP BY 1)
SELECT count(*) AS n_total, count(*) FILTER (n < 2) AS n_skipped_short, CAST(0 AS BIGINT) AS n_padded_short,
  count(*) FILTER (n >= 2 AND bad) AS n_skipped_nan, count(*) FILTER (n >= 2 AND NOT bad) AS n_kept FROM s""")
def v6_report(spark, folder):
    return embedding.report(flows(spark, folder), FLOW_ROLES)


@add("v7_embedding_distance", ctes(EV, FLOW, OWN) + """, vec AS (SELECT flow, flow % 2 = 1 AS syn, list(mag ORDER BY dim) AS v FROM phi GROUP BY 1)
SELECT r.flow, round(min(list_distance(r.v, s.v)), 6) AS nearest FROM vec r, vec s WHERE NOT r.syn AND s.syn GROUP BY 1""")
def v7(spark, folder):
    # Embedded once for the search and the way back to the flows: sums taken anew may differ in their last digits.
    vecs = checkpointed(embedding.vectors(v6(spark, folder), ["flow"]).withColumn("is_synth", F.col("flow") % 2 == 1))
    found = knn.distances(vecs, None, "vec", 1)
    real = vecs.where("not is_synth").select("flow", "vec")
    return real.join(found, "vec").select("flow", F.element_at("best", 1).alias("nearest"))


@add("scl8_dft_magnitudes", ctes(EV, FLOW, OWN) + "SELECT flow, channel, freq, round(mag, 6) AS mag, round(mag * mag, 6) AS power FROM phi")
def scl8(spark, folder):
    return v6(spark, folder).select("flow", "channel", "freq", "mag", (F.col("mag") * F.col("mag")).alias("power"))


@add("scl9_vector_distances", ctes(EMB) + """, pv AS (SELECT label, arg_min(v, vec_id) AS c FROM emb e JOIN embeddings b USING (vec_id) GROUP BY 1)
SELECT e.vec_id, round(list_distance(e.v, pv.c), 6) AS l2, round(pow(list_distance(e.v, pv.c), 2), 6) AS squared,
  round(list_sum(list_transform(list_zip(e.v, pv.c), lambda z: abs(z[1] - z[2]))), 6) AS l1
FROM emb e JOIN embeddings b USING (vec_id) JOIN pv ON pv.label = b.label""")
def scl9(spark, folder):
    df = vectors(spark, folder)
    first = df.groupBy("label").agg(F.min_by("vec", "vec_id").alias("c"))
    return df.join(first, "label").select(
        "vec_id", l2_distance("vec", "c").alias("l2"), squared_distance("vec", "c").alias("squared"), l1_distance("vec", "c").alias("l1")
    )
