"""Casts, encodings, sources and roll-ups over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.catalog.base import EV, Catalogue, ctes, events, ks_cte, table
from chronofid.functions.labels import alpha_rank, column_token, plain_label
from chronofid.functions.numeric import bool_to_int, clip01, to_double, to_long
from chronofid.functions.times import (
    day_of, digits_to_time, floor_time, month_day, month_number, month_of, parse_time, seconds, ymd,
)
from chronofid.functions.vectors import class_text, parse_code_map
from chronofid.operators import encode
from chronofid.operators.distributions import ks_by
from chronofid.operators.joins import Relationship, attach_parent
from chronofid.operators.ordered import ordered
from chronofid.operators.sampling import first_rows
from chronofid.plans.columns import covered_share
from chronofid.plans.roles import pair_of
from chronofid.sources import scores as sc
from chronofid.sources import tables as src
from chronofid.session import checkpointed, shared_folder

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("src1_typed_scan", """SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 6) AS c_acctbal FROM customer""")
def src1(spark, folder):
    schema = T.StructType([
        T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType()),
    ])
    return src.read_table(spark, f"{folder}/customer.parquet", schema, row=None)


PART = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_retailprice", T.DoubleType()),
])


@add("src1_csv_scan", """SELECT p_partkey, p_name, round(p_retailprice, 6) AS p_retailprice FROM part""")
def src1_csv(spark, folder):
    path = f"{shared_folder(spark)}/part.csv"
    # Column order on disk differs from the schema: columns are found by header name.
    table(spark, folder, "part").select("p_retailprice", "p_name", "p_partkey").write.csv(path, header=True)
    return src.read_table(spark, path, PART, row=None)


@add("src4_gzip_shards", """SELECT p_partkey, p_name, round(p_retailprice, 6) AS p_retailprice FROM part""")
def src4(spark, folder):
    path = shared_folder(spark)
    df = table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice")
    df.repartition(4, "p_partkey").write.csv(path, header=False, compression="gzip")
    return src.read_shards(spark, [path], PART)


@add("snk1_variant_tables", """
SELECT o_orderkey, o_orderstatus, variant FROM orders, (VALUES ('raw'), ('default')) v(variant)
WHERE variant = 'raw' OR o_orderkey IN (SELECT min(o_orderkey) FROM orders GROUP BY o_custkey)""")
def snk1(spark, folder):
    root = shared_folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    src.write_variant(orders, root, "raw")
    src.write_variant(first_rows(orders, ["o_custkey"], "o_orderkey"), root, "default")
    return src.read_variants(spark, root).select("o_orderkey", "o_orderstatus", "variant")


VARIANTS = """v AS (SELECT event_id, user_id, event_type AS variant_source,
    CASE event_type WHEN 'click' THEN 'interp_fill' WHEN 'view' THEN 'default' WHEN 'signup' THEN 'raw' WHEN 'error' THEN 'real' ELSE 'other' END AS variant FROM events),
r AS (SELECT *, CASE variant WHEN 'interp_fill' THEN 0 WHEN 'default' THEN 1 WHEN 'raw' THEN 2 WHEN 'real' THEN 3 END AS rk FROM v)"""


@add("src3_variant_fallback", ctes(VARIANTS) + """
SELECT event_id, user_id, variant FROM (SELECT *, min(rk) OVER (PARTITION BY user_id) AS best FROM r WHERE rk IS NOT NULL) q WHERE rk = best""")
def src3(spark, folder):
    names = {"click": "interp_fill", "view": "default", "signup": "raw", "error": "real"}
    variant = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("other"))
    df = table(spark, folder, "events").select("event_id", "user_id", variant.alias("variant"))
    return src.pick_variant(df, ["user_id"], "interp_fill")


@add("src5_signal_rows", """
WITH s AS (SELECT vec_id, label, unnest(range(0, 16)) AS step, embedding FROM embeddings)
SELECT vec_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MILLISECOND * (10 * step) AS ts, CAST(step AS INTEGER) AS step,
  round(CAST(embedding[4 * step + 1] AS DOUBLE), 6) AS lead_0, round(CAST(embedding[4 * step + 2] AS DOUBLE), 6) AS lead_1,
  round(CAST(embedding[4 * step + 3] AS DOUBLE), 6) AS lead_2, round(CAST(embedding[4 * step + 4] AS DOUBLE), 6) AS lead_3, label FROM s""")
def src5(spark, folder):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    signal = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    records = table(spark, folder, "embeddings").select("vec_id", start.alias("start"), signal.alias("signal"), "label")
    return src.signal_rows(records, "vec_id", "start", "signal", 0.01)


@add("prj2_numeric_coercion", """
SELECT event_id, TRY_CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad,
       CAST(round_even(value, 0) AS BIGINT) AS whole FROM events""")
def prj2(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", to_double(F.get_json_object("props", "$.k")).alias("k"), to_double("event_type").alias("bad"), to_long("value").alias("whole")
    )


@add("prj3_time_coercion", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS TIMESTAMP) END AS parsed, CAST(o_orderdate AS TIMESTAMP) AS by_format FROM orders""")
def prj3(spark, folder):
    df = table(spark, folder, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return df.select(
        "o_orderkey",
        parse_time(F.when(F.col("o_orderstatus") == "P", F.lit("no date")).otherwise(text)).alias("parsed"),
        parse_time(F.date_format("o_orderdate", "dd/MM/yyyy"), "%d/%m/%Y").alias("by_format"),
    )


@add("prj4_seconds", "SELECT event_id, round(epoch_us(ts) / 1000000.0, 6) AS t FROM events")
def prj4(spark, folder):
    return table(spark, folder, "events").select("event_id", seconds("ts").alias("t"))


@add("prj5_composed_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS composed, strftime(o_orderdate, '%m-%d') AS month_day,
       CASE WHEN day(o_orderdate) <= 28 THEN make_date(year(o_orderdate), 2, day(o_orderdate)) WHEN day(o_orderdate) = 29 AND year(o_orderdate) % 4 = 0
            THEN make_date(year(o_orderdate), 2, 29) END AS february FROM orders""")
def prj5(spark, folder):
    short = F.when(F.year("o_orderdate") < 2000, F.year("o_orderdate") - 1900).otherwise(F.year("o_orderdate"))
    m, d = F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey", ymd(short, m, d, base=1900).alias("composed"), month_day(m, d).alias("month_day"),
        ymd(F.year("o_orderdate"), F.lit(2), d).alias("february"),
    )


@add("prj6_truncated_time", """SELECT event_id, CAST(ts AS DATE) AS day, CAST(date_trunc('month', ts) AS DATE) AS month FROM events""")
def prj6(spark, folder):
    return table(spark, folder, "events").select("event_id", day_of("ts").alias("day"), month_of("ts").alias("month"))


@add("prj8_rank_time", """
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_rank,
  CAST(CASE WHEN regexp_full_match(lower(event_type), '[a-z]+') THEN list_reduce(list_transform(string_split(lower(event_type), ''),
       lambda x: CAST(ascii(x) - 96 AS HUGEINT)), lambda a, b: a * 26 + b) ELSE -1 END AS DOUBLE) AS alpha FROM events""")
def prj8(spark, folder):
    df = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    ranked = ordered(df, ["user_id"], ["ts", "event_id"]).numbered("row_rank").result()
    return ranked.select("event_id", "user_id", "row_rank", alpha_rank("event_type").cast("double").alias("alpha"))


@add("prj11_category_codes", """
WITH v AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0) q)
SELECT p_partkey, CAST(coalesce(code, -1) AS INTEGER) AS p_brand FROM part LEFT JOIN v USING (p_brand)""")
def prj11(spark, folder):
    part = table(spark, folder, "part")
    real = part.where(F.col("p_partkey") % 2 == 0)
    return encode.category_codes(part.select("p_partkey", "p_brand"), real, "p_brand")


@add("prj11_encode_values", """
WITH v AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS code FROM (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0) q)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(coalesce(code, -1) AS DOUBLE) AS l_returnflag, CAST(l_quantity AS DOUBLE) AS l_quantity
FROM lineitem LEFT JOIN v USING (l_returnflag)""")
def prj11_values(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_quantity")
    text = lines.withColumn("l_quantity", F.col("l_quantity").cast("string"))
    return encode.encode_values(text, text.where("l_orderkey % 2 = 0"), ["l_returnflag", "l_quantity"])


@add("prj12_one_hot", """
SELECT event_id, CAST(event_type = 'click' AS DOUBLE) AS event_type_is_click, CAST(event_type = 'error' AS DOUBLE) AS event_type_is_error,
  CAST(event_type NOT IN ('click', 'error') AS DOUBLE) AS "event_type_is_OTHER" FROM events""")
def prj12(spark, folder):
    df = table(spark, folder, "events").select("event_id", "event_type")
    return encode.expand_categories(df, df.where(F.col("event_type").isin("click", "error")), ["event_type"])


@add("prj12_sparse_indicators", """
WITH cells AS (SELECT o_orderkey, 'o_orderdate' AS "column", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS category FROM orders
  UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders),
known AS (SELECT "column", category, row_number() OVER (PARTITION BY "column" ORDER BY category) - 1 AS category_id
  FROM (SELECT DISTINCT "column", category FROM cells WHERE o_orderkey % 2 = 0) q)
SELECT o_orderkey, "column", coalesce(category_id, -1) AS category_id, CAST(1 AS DOUBLE) AS indicator FROM cells LEFT JOIN known USING ("column", category)""")
def prj12_sparse(spark, folder):
    df = table(spark, folder, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return encode.sparse_indicators(df, df.where("o_orderkey % 2 = 0"), ["o_orderkey"], ["o_orderdate", "o_orderpriority", "o_custkey"])


@add("prj13_packed_dates", """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS from_number, CAST(o_orderdate AS TIMESTAMP) AS year_last FROM orders""")
def prj13(spark, folder):
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("double")
    return table(spark, folder, "orders").select(
        "o_orderkey", digits_to_time(number, "%Y%m%d", numeric=True).alias("from_number"),
        digits_to_time(F.date_format("o_orderdate", "d.MM.yyyy"), "%d%m%Y").alias("year_last"),
    )


@add("prj14_dates_by_rank", """
WITH raw AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS u FROM (SELECT DISTINCT p_brand FROM part) a),
ref AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS r FROM (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS d FROM orders) b),
m AS (SELECT p_brand, d FROM raw JOIN ref ON pos = CASE WHEN u = 1 THEN 0 ELSE CAST(round_even(i * ((r - 1.0) / (u - 1)), 0) AS BIGINT) END)
SELECT p_partkey, d AS shipped FROM part JOIN m USING (p_brand)""")
def prj14(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("shipped"))
    orders = table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp_ntz").alias("shipped"))
    return encode.repair_dates(part, orders, "shipped")


@add("prj15_encode_table", """
WITH v AS (SELECT o_orderstatus AS s, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderkey % 2 = 0) q)
SELECT o_orderkey, CAST(code AS INTEGER) AS o_orderstatus, CAST(round_even(o_totalprice, 0) AS BIGINT) AS o_totalprice,
       CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent FROM orders JOIN v ON o_orderstatus = s""")
def prj15(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyyMMdd").alias("o_orderdate"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "True").otherwise("False").alias("urgent"),
    )
    columns = {
        "o_orderkey": {"sdtype": "id"}, "o_orderstatus": {"sdtype": "categorical"},
        "o_totalprice": {"sdtype": "numerical", "computer_representation": "Int64"},
        "o_orderdate": {"sdtype": "datetime", "datetime_format": "%Y%m%d"}, "urgent": {"sdtype": "boolean"},
    }
    return encode.encode_table(df, df.where("o_orderkey % 2 = 0"), columns)


@add("prj16_null_fill", """
WITH m AS (SELECT doc_id, n_chars, quality, CASE WHEN quality IS NOT NULL THEN lang END AS lang FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, n_chars, round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM m)), 6) AS quality, coalesce(lang, '?') AS lang FROM m""")
def prj16(spark, folder):
    joined = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    df = joined.select("doc_id", "n_chars", "quality", F.when(F.col("quality").isNotNull(), F.col("lang")).alias("lang"))
    columns = {
        "n_chars": {"sdtype": "numerical", "computer_representation": "Int64"}, "quality": {"sdtype": "numerical"},
        "lang": {"sdtype": "categorical"},
    }
    return encode.fill_nulls(df, columns)


@add("prj17_model_frame", """
SELECT o_custkey, round(o_totalprice, 6) AS o_totalprice, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS o_orderdate FROM orders""")
def prj17(spark, folder):
    return encode.model_frame(table(spark, folder, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@add("scl1_text_functions", r"""
SELECT p_partkey, trim(p_name) AS label, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, lower(p_type) AS lowered,
  lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, concat_ws('-', p_brand, p_type) AS joined, regexp_full_match(p_brand, 'Brand#\d{2}') AS two_digits,
  substring(p_name, 1, 3) AS start, 'Brand_23_1_23_' AS safe FROM part""")
def scl1(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", plain_label("p_name").alias("label"), F.regexp_replace("p_brand", r"\D", "").alias("digits"),
        F.lower("p_type").alias("lowered"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.concat_ws("-", "p_brand", "p_type").alias("joined"), F.col("p_brand").rlike(r"^Brand#\d{2}$").alias("two_digits"),
        F.substring("p_name", 1, 3).alias("start"), F.lit(column_token("Brand#1#")).alias("safe"),
    )


@add("scl2_date_functions", """
SELECT event_id, CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS week, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS hour,
  strftime(ts, '%Y-%m-%d') AS text, CAST(year(ts) * 100 + month(ts) AS INTEGER) AS month_no, CAST(ts AS DATE) + 3 AS later FROM events""")
def scl2(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", floor_time("ts", 604800).alias("week"), floor_time("ts", 3600).alias("hour"),
        F.date_format("ts", "yyyy-MM-dd").alias("text"), month_number("ts").alias("month_no"), F.date_add(F.to_date("ts"), 3).alias("later"),
    )


@add("scl3_math_functions", """
SELECT event_id, round(abs(value - 30), 6) AS distance, CAST(round_even(value, 0) AS DOUBLE) AS even, round(greatest(0, least(1, value / 50)), 6) AS clipped,
  round(sqrt(value), 6) AS root, CAST(floor(value / 7) AS BIGINT) AS sevens, CAST(value > 30 AS INTEGER) AS high FROM events""")
def scl3(spark, folder):
    v = F.col("value")
    return table(spark, folder, "events").select(
        "event_id", F.abs(v - 30).alias("distance"), F.rint(v).alias("even"), clip01(v / 50).alias("clipped"), F.sqrt(v).alias("root"),
        F.floor(v / 7).cast("long").alias("sevens"), bool_to_int(v > 30).alias("high"),
    )


@add("scl7_class_text", """
SELECT o_orderkey, coalesce(t, '') AS classes FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(n_name, '|' ORDER BY n_name) AS t FROM (
    SELECT DISTINCT l_orderkey, n_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) q GROUP BY 1) c
ON o_orderkey = l_orderkey""")
def scl7(spark, folder):
    codes = F.concat(F.lit("{"), F.array_join(F.collect_set(F.concat(F.lit("'"), F.col("l_suppkey"), F.lit("': 100.0"))), ", "), F.lit("}"))
    texts = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(codes.alias("codes"))
    suppliers = table(spark, folder, "supplier").withColumn("code", F.col("s_suppkey").cast("string"))
    classes = attach_parent(suppliers, table(spark, folder, "nation"), Relationship("nation", "supplier", "n_nationkey", "s_nationkey"))
    records = table(spark, folder, "orders").select("o_orderkey").join(texts, "o_orderkey", "left")
    records = records.withColumn("codes", parse_code_map("codes"))
    return class_text(records, "o_orderkey", "codes", classes, "code", "n_name", "classes").select("o_orderkey", "classes")


@add("set3_labelled_union", """
SELECT o_orderkey AS id, o_totalprice AS amount, NULL AS balance, false AS is_synth FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal, true FROM customer""")
def set3(spark, folder):
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return pair_of(orders, customers)


SCORES = ctes(EV, "e2 AS (SELECT *, CASE WHEN hour(ts) < 12 THEN 'raw' ELSE 'default' END AS variant FROM ev)",
              ks_cte("x", "e2", "event_type, variant", "value"), ks_cte("y", "e2", "event_type, variant", "k"), """
s AS (SELECT event_type AS model, variant, 'sd' AS family, 'KSComplement' AS metric, 'value' AS feature, 1 - ks AS score FROM x
  UNION ALL SELECT event_type, variant, 'sd', 'KSComplement', 'k', 1 - ks FROM y
  UNION ALL SELECT a.event_type, a.variant, 'timestamp', 'TemporalRangeCompliance', '*', avg(CASE WHEN a.t BETWEEN b.lo AND b.hi THEN 1.0 ELSE 0.0 END)
  FROM e2 a JOIN (SELECT event_type, variant, min(t) AS lo, max(t) AS hi FROM e2 WHERE NOT syn GROUP BY 1, 2) b ON a.event_type = b.event_type AND a.variant = b.variant
  WHERE a.syn GROUP BY 1, 2)""")


def scores(spark, folder):
    """Scores with the event type as model and the half of the day as variant: one job for all of them."""
    variant = F.when(F.hour("ts") < 12, "raw").otherwise("default")
    df = events(spark, folder).withColumnsRenamed({"event_type": "model"}).withColumn("variant", variant)
    keys = ["model", "variant"]

    def shaped(frame, family, metric, feature, score):
        return frame.select(
            F.lit("events").alias("dataset"), *keys, F.lit(family).alias("family"), F.lit(metric).alias("metric"),
            F.lit("events").alias("table"), F.lit(feature).alias("feature"), score.alias("score"),
        )

    timed = df.select(*keys, "is_synth", seconds("ts").alias("value"))
    parts = [shaped(ks_by(df, keys, c), "sd", "KSComplement", c, 1 - F.col("ks")) for c in ("value", "k")]
    parts.append(shaped(covered_share(timed, keys), "timestamp", "TemporalRangeCompliance", "*", F.col("score")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@add("snk4_scores_by_variant", SCORES + """
SELECT 'events' AS dataset, model, variant, round(avg(score) FILTER (metric = 'KSComplement'), 6) AS "KSComplement",
  round(avg(score) FILTER (metric = 'TemporalRangeCompliance'), 6) AS "TemporalRangeCompliance", CAST(NULL AS DOUBLE) AS "GridCompleteness" FROM s GROUP BY 2, 3""")
def snk4_variant(spark, folder):
    return sc.by_variant(scores(spark, folder), ["KSComplement", "TemporalRangeCompliance", "GridCompleteness"])


@add("snk4_scores_by_family", SCORES + """
SELECT 'events' AS dataset, model, round(avg(score) FILTER (family = 'sd' AND variant = 'default'), 6) AS sd,
  round(avg(score) FILTER (family = 'timestamp' AND variant = 'raw'), 6) AS timestamp FROM s GROUP BY 2""")
def snk4_family(spark, folder):
    return sc.by_family(scores(spark, folder), ["sd", "timestamp"])


@add("snk2_stored_scores", SCORES + """SELECT 'events' AS dataset, model, variant, family, metric, 'events' AS "table", feature, round(score, 6) AS score FROM s""")
def snk2(spark, folder):
    path = shared_folder(spark)
    sc.write_scores(scores(spark, folder), path)
    return spark.read.parquet(path)


def score_files(spark, folder):
    """JSON score files that Spark writes, one per event type (as model) and family, and a second one for ``sd``."""
    models = table(spark, folder, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.avg("value").alias("a"), F.avg(F.get_json_object("props", "$.k").cast("double")).alias("b"),
        F.max("value").alias("m"), F.count(F.lit(1)).cast("double").alias("n"),
    )
    entry = lambda *pairs: F.create_map(*[x for name, value in pairs for x in (F.lit(name), value)])
    per_metric = F.struct(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y")).alias("sequence_length_similarity_users"),
        F.col("n").alias("temporal_cardinality_shape_similarity"),
    )
    summary = entry(("sequence_length_similarity", F.col("a")), ("temporal_cardinality_shape_similarity_all", F.col("b")), ("dynamic_khop", F.col("m")))
    details = entry(("dynamic_khop_1", F.struct((F.col("b") * 2).alias("score"))))
    bodies = {
        "structural": F.struct(summary.alias("summary"), F.when(F.col("n") % 2 == 0, per_metric).alias("per_metric"), details.alias("details")),
        "sd": F.struct(entry(("KSComplement", F.col("a")), ("TVComplement", F.col("b"))).alias("summary")),
        "sd 2": F.struct(entry(("KSComplement", F.col("m"))).alias("summary")),
        "timestamp": F.struct(entry(("GridCompleteness", F.col("n"))).alias("summary")),
    }
    written = models.select("model", *[body.alias(name) for name, body in bodies.items()])
    root = shared_folder(spark)
    # A file is named by its folders, so each of these few rows is a write of its own.
    written = checkpointed(written)
    for row in written.select("model").collect():
        for name in bodies:
            path = f"{root}/events/{row['model']}/{name.split()[0]}"
            body = written.where(F.col("model") == row["model"]).select(F.col(f"`{name}`").alias("body")).select("body.*")
            sc.write_score_file(body, path)
    return root


@add("snk3_score_files", """
WITH s AS (SELECT event_type AS model, avg(value) AS a, avg(CAST(regexp_extract(props, '-?[0-9]+') AS DOUBLE)) AS b, max(value) AS m, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
f AS (
  SELECT model, 'default' AS variant, 'sd' AS family, 'KSComplement' AS metric, (a + m) / 2 AS score FROM s
  UNION ALL SELECT model, 'default', 'sd', 'TVComplement', b FROM s
  UNION ALL SELECT model, 'raw', 'timestamp', 'GridCompleteness', n FROM s
  UNION ALL SELECT model, 'default', 'structural', 'SequenceLengthSimilarity', CASE WHEN n % 2 = 0 THEN (a + b) / 2 ELSE a END FROM s
  UNION ALL SELECT model, 'default', 'structural', 'TemporalCardinalityShapeSimilarity', CASE WHEN n % 2 = 0 THEN n ELSE b END FROM s
  UNION ALL SELECT model, 'default', 'structural', 'DynamicKHopCorrelationSimilarity', CASE WHEN n % 2 = 0 THEN m ELSE b * 2 END FROM s)
SELECT 'events' AS dataset, model, variant, family, metric, round(score, 6) AS score FROM f""")
def snk3(spark, folder):
    return sc.read_score_files(spark, score_files(spark, folder))
