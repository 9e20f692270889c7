import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronofid.llm import mixing

from .conftest import sentence

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory, messy, messy_rows, messy_labels, spark):
    path = tmp_path_factory.mktemp("tables")
    messy.write.parquet(f"{path}/documents.parquet")
    messy_labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, messy_rows[2][1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_each_stage_on_messy_and_no_rows(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = stage(spark, docs, folder)
    assert set(docs.columns) <= set(got.columns)
    if name != "sharding":
        assert got.columns == docs.columns
    got.write.format("noop").mode("overwrite").save()
    assert stage(spark, docs.where(F.lit(False)), folder).count() == 0


def test_one_document_of_each_group_stays(spark, folder, messy_rows):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = sorted(str(r.doc_id) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect())
    # 0..5 lead the copies and near copies, one of them without an id; texts without words link with nothing.
    assert got == sorted(["0", "1", "2", "3", "4", "5", "30", "31", "32", "33", "34", "35", "40", "41", "None"])


A, B = sentence(random.Random(1), 60), sentence(random.Random(2), 60)
REPEATED = [
    ([(3, A), (5, A), (5, B)], [(3, A), (5, B)]),
    ([(3, B), (5, A), (5, B)], [(3, B), (5, A)]),
    ([(5, A), (5, A), (5, B), (5, B + " tail")], [(5, A), (5, B)]),
    ([(None, A), (None, A), (None, B), (2, B), (None, None), (None, "")], [(2, B), (None, A), (None, None), (None, "")]),
    ([((1 << 63) - 1, A), ((1 << 63) - 1, B)], [((1 << 63) - 1, A), ((1 << 63) - 1, B)]),
]


@pytest.mark.parametrize("rows, want", REPEATED)
def test_no_text_is_lost_under_a_repeated_id(spark, rows, want):
    for seed in range(2):
        order = random.Random(seed).sample(rows, len(rows))
        docs = spark.createDataFrame([(d, t, f"s{k}") for k, (d, t) in enumerate(order)], "doc_id long, text string, source string")
        got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
        near = lambda pairs: sorted((str(d), (t or "").removesuffix(" tail")) for d, t in pairs)
        assert near(got) == near(want)


def test_a_leak_takes_only_its_own_text(spark, folder, messy_rows):
    leak = messy_rows[2][1]
    rows = [(None, leak), (None, "clean text without an id"), (None, None), (7, leak), (7, "clean text under a repeated id"), (8, "another clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_leaks(spark, docs, folder).collect()), key=str)
    assert got == sorted((r for r in rows if r[1] != leak), key=str)


def test_rows_without_an_id_are_drawn_one_by_one(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"good {i}") for i in range(6)] + [(None, f"text number {k}") for k in range(200)], "doc_id long, text string")
    domains = spark.createDataFrame([(i, "clean" if i % 2 else "junk") for i in range(6)], "doc_id long, domain string")
    models = mixing.fit_domains(docs, domains, ["clean", "junk"])
    monkeypatch.setattr(mixing, "fitted", lambda *_: (models, None, [[0.5, 0.5]]))  # a rate of one half for every row
    assert 60 < mixing.mixed_documents(docs, domains, {"clean": 0.5, "junk": 0.5}).where("doc_id is null").count() < 140


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables not present")
def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert 100 < got.count() <= 250 and {"shard", "slot"} <= set(got.columns)
