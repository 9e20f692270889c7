"""Reading, writing, metadata and the score roll-up."""

import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofid.functions.labels import alpha_order, alpha_rank, boolean_label, column_token, indicators, join_key, token
from chronofid.functions.times import coerce_time, convert_time, digits_to_time, parse_time, ymd
from chronofid.operators import encode
from chronofid.operators.joins import Relationship, attach_parent
from chronofid.plans.roles import labelled
from chronofid.sources import scores, tables
from chronofid.sources.metadata import dataset

METADATA = {
    "tables": {
        "shops": {"primary_key": "Shop", "columns": {"Shop": {"sdtype": "id"}, "Size": {"sdtype": "numerical", "computer_representation": "Int64"}}},
        "weeks": {"columns": {
            "Shop": {"sdtype": "id"}, "Date": {"sdtype": "datetime", "datetime_format": "%Y-%m-%d"},
            "Sales": {"sdtype": "numerical"}, "Open": {"sdtype": "boolean"},
        }},
    },
    "relationships": [
        {"parent_table_name": "shops", "child_table_name": "weeks", "parent_primary_key": "Shop", "child_foreign_key": "Shop"}
    ],
}
TRAITS = {"tables": {"weeks": {
    "time_col": "Date", "periodicity": "regular", "time_representation": "absolute", "trajectory_independence": "dependent"}}}


def test_roles_come_from_metadata_and_traits():
    info = dataset("shops", METADATA, TRAITS)
    roles = info.roles("weeks")
    assert (roles.key, roles.time, roles.num_cols, roles.cat_cols) == ("Shop", "Date", ["Sales"], ["Open"])
    assert (roles.periodicity, roles.independence) == ("regular", "dependent")
    assert info.cross_sectional("weeks") and not dataset("shops", METADATA).cross_sectional("weeks")
    assert info.children() == ["weeks"] and info.tables["shops"].schema()["Size"].dataType == T.LongType()


def test_csv_is_read_by_header_name(spark, tmp_path):
    path = tmp_path / "weeks.csv"
    path.write_text("Sales,Shop,Date,Open\n1.5,3,2020-01-01,True\nbad,4,2020-01-08,\n")
    schema = dataset("shops", METADATA).tables["weeks"].schema()
    rows = tables.read_table(spark, str(path), schema).orderBy("row_ix").collect()
    assert [(r["Shop"], r["Sales"], r["Open"]) for r in rows] == [(3, 1.5, "True"), (4, None, None)]
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, "weeks.xlsx")


def test_shards(spark, tmp_path):
    for i in range(3):
        with gzip.open(tmp_path / f"part-{i}.csv.gz", "wt") as handle:
            handle.write(f"{i},a{i}\n{i + 10},b{i}\n")
    paths = [str(p) for p in tmp_path.glob("*.gz")]
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])
    assert tables.read_shards(spark, paths, schema).count() == 6
    assert sorted(r["n"] for r in tables.read_shards(spark, paths, schema, 2).collect()) == [0, 1, 10, 11]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_variants_are_partitions(spark, tmp_path, fmt):
    root = str(tmp_path / "weeks")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "Shop long, Sales double")
    tables.write_variant(df, root, "raw", fmt)
    tables.write_variant(df.where("Shop = 1"), root, "default", fmt)
    tables.write_variant(df.where("Shop = 2"), root, "default", fmt)
    back = tables.read_variants(spark, root, fmt)
    assert {r["variant"]: r["count"] for r in back.groupBy("variant").count().collect()} == {"raw": 2, "default": 1}
    picked = tables.pick_variant(back, ["Shop"], "interp_fill").collect()
    assert {int(r["Shop"]): r["variant"] for r in picked} == {1: "raw", 2: "default"}


def test_signals(spark):
    df = spark.sql("select 7 id, timestamp_ntz'2020-01-01 00:00:00' s, array(array(1.0D, 2.0D), array(3.0D, 4.0D)) x, 'n' kind")
    rows = tables.signal_rows(df, "id", "s", "x", 0.002).orderBy("step").collect()
    assert [(r["step"], r["lead_0"], r["lead_1"], r["kind"]) for r in rows] == [(0, 1.0, 2.0, "n"), (1, 3.0, 4.0, "n")]
    assert rows[1]["ts"].microsecond == 2000


def test_score_files_roll_up(spark, tmp_path):
    def put(model, family, name, summary):
        folder = tmp_path / "shops" / model / family
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(json.dumps({"summary": summary}))

    put("m1", "sd", "sd_metrics_weeks_default.json", {"KSComplement": 0.5, "TVComplement": None})
    put("m1", "sd", "sd_metrics_shops_default.json", {"KSComplement": 0.7})
    put("m1", "timestamp", "m1.json", {"TimestampUniqueness": 0.25})
    put("m1", "structural", "struct_raw.json", {"sequence_length_similarity__weeks": 0.5, "sequence_length_similarity__days": 1.0})
    put("m1", "longitudinal", "longitudinal_interp_fill.json", {"TransitionMatrixSimilarity": 0.4})
    put("m1", "trajectory_privacy", "default.json", {"temporal_dcr": 2.0})
    read = scores.read_score_files(spark, str(tmp_path))
    wide = {r["variant"]: r for r in scores.by_variant(read).collect()}
    assert wide["default"]["KSComplement"] == pytest.approx(0.6) and wide["default"]["TVComplement"] is None
    assert wide["raw"]["TimestampUniqueness"] == 0.25 and wide["raw"]["SequenceLengthSimilarity"] == 0.75
    row = scores.by_family(read).first()
    assert (row["sd"], row["timestamp"], row["structural"], row["longitudinal"], row["privacy"], row["cross_sectional"]) == (
        pytest.approx(0.6), 0.25, 0.75, 0.4, 2.0, None)


def test_structural_scores_under_other_headings(spark, tmp_path):
    def put(model, payload):
        folder = tmp_path / "shops" / model / "structural"
        folder.mkdir(parents=True)
        (folder / "struct_default.json").write_text(json.dumps(payload))

    length, shape = "sequence_length_similarity", "temporal_cardinality_shape_similarity"
    put("per", {"summary": {length: 0.1, shape: 0.2}, "per_metric": {length: {f"{length}__a": 0.5, "b": 0.7}, "other": {"x": 9.0}}, "details": {shape: {"score": 0.9}}})
    put("flat", {"per_metric": {length: 0.25, "unknown": 1.0}})
    put("detail", {"summary": {length: 0.1, "KSComplement": 0.3}, "details": {length: {"score": 0.8, "n": 3}, shape: {"note": "none"}, "other": {"score": 5}}})
    got = {(r.model, r.metric): r.score for r in scores.read_score_files(spark, str(tmp_path)).collect()}
    assert got == {
        ("per", "SequenceLengthSimilarity"): pytest.approx(0.6), ("per", "TemporalCardinalityShapeSimilarity"): 0.2,
        ("flat", "SequenceLengthSimilarity"): 0.25, ("detail", "SequenceLengthSimilarity"): 0.8, ("detail", "KSComplement"): 0.3,
    }


def test_scores_are_stored_without_nan(spark, tmp_path):
    df = spark.createDataFrame([("KSComplement", "x", float("nan")), ("KSComplement", "y", 0.5)], "metric string, feature string, score double")
    scores.write_scores(labelled(df, "shops", "m1", "raw", "sd", "weeks"), str(tmp_path / "scores"))
    back = spark.read.parquet(str(tmp_path / "scores"))
    assert {r["feature"]: r["score"] for r in back.collect()} == {"x": None, "y": 0.5} and back.columns[-2:] == ["dataset", "family"]


def test_labels_and_times(spark):
    def value(expr):
        return spark.range(1).select(expr.alias("v")).first()["v"]

    assert value(boolean_label(F.lit(" TRUE "))) == "True" and value(boolean_label(F.lit("0.0"))) == "False"
    assert value(join_key(F.lit(3.0))) == value(join_key(F.lit(3))) == value(join_key(F.lit(" 3 "))) == "3"
    assert value(token(F.lit(None).cast("double"))) == "__NA__" and value(token(F.lit(2.5))) == "2.5"
    assert value(alpha_rank(F.lit("aA"))) == 27 and value(alpha_rank(F.lit("a1"))) == -1
    long_ = [value(alpha_rank(F.lit("z" * 13 + last))) for last in "abc"]
    assert long_[1] - long_[0] == long_[2] - long_[1] == 1
    orders = [value(alpha_order(F.lit(t))) for t in ("a1", "b", "aa", "z" * 40 + "a", "z" * 40 + "b")]
    assert orders == sorted(orders) and len(set(orders)) == 5
    assert len({column_token(t) for t in ("a b", "a/b", "a_b", "a  b", "ab")}) == 5
    assert value(ymd(F.lit(95), F.lit(2), F.lit(30), base=1900)) is None
    assert str(value(ymd(F.lit(95), F.lit(2), F.lit(3), base=1900))) == "1995-02-03"
    assert value(parse_time(F.lit("2020-13-40"))) is None and value(parse_time(F.lit("03/02/2020"), "%d/%m/%Y")).month == 2
    assert value(digits_to_time(F.lit(950103.0), "%y%m%d", numeric=True)).day == 3


def test_indicators_keep_categories_apart(spark):
    names = ["a b", "a/b", "A b", "x" * 60 + "1", "x" * 60 + "2", "OTHER", None, "unseen"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    got = df.select("c", *(e.alias(n) for n, e in indicators("c", names[:6]).items())).collect()
    assert len(got[0]) == 8 and all(sum(r[1:]) == 1.0 for r in got)
    assert [r["c_is_OTHER"] for r in got] == [0.0] * 6 + [1.0, 1.0]


def test_formats_with_literals_and_names(spark):
    cases = [("%Y-%m-%d", "2020-02-03"), ("%Y-%m-%dT%H:%M:%S", "2020-02-03T00:00:00"), ("%d-%b-%Y", "03-Feb-2020"), ("%Y/%m/%d %H:%M:%S.%f", "2020/02/03 00:00:00.000000"), ("%d of %B, %Y", "03 of February, 2020"), ("%I:%M %p on %d.%m.%y", "12:00 AM on 03.02.20"), ("%Y%m%d", "20200203"), ("%Y%j", "2020034")]
    df = spark.range(1)
    for fmt, text in cases:
        for read in (parse_time, digits_to_time):
            got = df.select(read(F.lit(text), fmt).alias("v")).first()["v"]
            assert got is not None and (got.year, got.month, got.day, got.hour) == (2020, 2, 3, 0), (fmt, read)
    with pytest.raises(ValueError):
        parse_time(F.lit("x"), "%Q")


def test_dates_are_repaired_before_encoding(spark):
    real = spark.createDataFrame([("2020-01-01",), ("2020-01-02",), ("2020-01-03",)], "d string")
    synth = spark.createDataFrame([("2020-01-02",), ("aa",), ("bb",), ("cc",), (None,)], "d string")
    columns = {"d": {"sdtype": "datetime", "datetime_format": "%Y-%m-%d"}}
    got = sorted(str(r["d"])[:10] for r in encode.encode_table(synth, real, columns).collect())
    assert got == ["2020-01-01", "2020-01-02", "2020-01-02", "2020-01-03", "None"]
    with pytest.raises(ValueError):
        encode.encode_table(synth, real.where("d IS NULL"), columns)


def test_one_parent_row_per_key_is_the_same_every_time(spark):
    rel = Relationship("p", "c", "id", "id")
    parents = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (2, None, 1)], "id long, v string, o int")
    child = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    for frame in (parents, parents.orderBy("o"), parents.orderBy(F.desc("o")).repartition(3)):
        assert {(r.id, r.v) for r in attach_parent(child, frame, rel).collect()} == {(1, "a"), (2, None), (3, None), (None, None)}
        first = attach_parent(child, frame, Relationship("p", "c", "id", "id", parent_order="o"))
        assert {(r.id, r.v) for r in first.collect()} == {(1, "b"), (2, None), (3, None), (None, None)}


def test_signal_width_is_that_of_the_widest_step(spark):
    records = spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0, 4.0, 5.0], [6.0]]), (3, None)], "id long, s array<array<double>>")
    got = tables.signal_rows(records.withColumn("t", F.lit("2020-01-01").cast("timestamp_ntz")), "id", "t", "s", 0.5)
    assert [c for c in got.columns if c.startswith("lead")] == ["lead_0", "lead_1", "lead_2"]
    assert {(r.id, r.lead_0, r.lead_1, r.lead_2) for r in got.collect()} == {(1, 1.0, None, None), (1, 2.0, None, None), (2, 3.0, 4.0, 5.0), (2, 6.0, None, None)}


def test_encoding(spark):
    real = spark.createDataFrame([("b", "1"), ("a", "2"), (None, "3")], "c string, n string")
    synth = spark.createDataFrame([("b", "9"), ("z", "x"), (None, "5")], "c string, n string")
    codes = encode.category_codes(synth, real, "c").collect()
    assert sorted(r["c"] for r in codes) == [-1, -1, 1]
    mixed = {r["n"] for r in encode.encode_values(synth, real, ["n"]).collect()}
    assert mixed == {-1.0}
    numbers = encode.encode_values(real, real, ["n"]).collect()
    assert sorted(r["n"] for r in numbers) == [1.0, 2.0, 3.0]
    assert encode.varying(real.withColumn("one", F.lit(1)).withColumn("gap", F.when(F.col("n") == "1", 1)), ["c", "one", "gap"]) == ["c", "gap"]


def test_ranked_dates_span_the_reference(spark):
    ref = spark.sql("select cast(date'2020-01-01' + cast(id as int) as timestamp_ntz) d from range(10)")
    raw = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "d string")
    got = sorted((str(r["d"].date())) for r in encode.repair_dates(raw, ref, "d").collect())
    # Positions 0, 4.5 rounded to even 4, and 9.
    assert got == ["2020-01-01", "2020-01-01", "2020-01-05", "2020-01-10"]


def test_time_columns_become_times_or_numbers(spark):
    dates = spark.createDataFrame([("2020-01-02",), ("nonsense",)], "t string")
    assert [r["t"] is None for r in convert_time(dates, "t").collect()].count(True) == 1
    # Half of it parses, which is too little for the stricter rule.
    assert coerce_time(dates, "t").schema["t"].dataType.typeName() == "string"
    steps = spark.createDataFrame([("x",), ("y3",), (None,)], "t string").union(spark.createDataFrame([("-1.5",)], "t string"))
    assert sorted(r["t"] for r in convert_time(steps, "t").collect() if r["t"] is not None) == [-1.5]


def test_few_categories_go_to_the_rows(spark, monkeypatch):
    """With three values a shuffle by value would bring a third of all rows to one task."""
    df = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4]) for i in range(40)], "id long, c string")
    want = [(i, [0, 1, 2, -1][i % 4]) for i in range(40)]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = encode.category_codes(df, df.where("c IS NULL OR c <> 'c'"), "c", "<NA>")
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, few.collect())) == want
        monkeypatch.setattr(encode, "SMALL_VALUES", 2)
        many = encode.category_codes(df, df.where("c IS NULL OR c <> 'c'"), "c", "<NA>")
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
