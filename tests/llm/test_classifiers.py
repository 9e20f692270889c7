"""Toxicity, quality ranking, quality rules and mixing: held-out accuracy on planted classes, and defined cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofid.llm import mixing, preference, quality_rules, toxicity

from .conftest import sentence

TOXIC = ["vilebad", "nastyword", "awfulterm", "grimname"]


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        words = sentence(draw, draw.randint(60, 160)).split()
        toxic, bad = int(i % 6 == 0), int(i % 5 == 0)
        if toxic:
            for _ in range(4):
                words.insert(draw.randrange(len(words)), draw.choice(TOXIC).capitalize() + draw.choice([",", ".", ""]))
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "$%&" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, 1 - bad, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, held):
    got = scored.join(labels, "doc_id").where(held).select((F.col("score") >= 0.5).cast("int").alias("p"), label).toPandas()
    assert len(got) > 100
    return (got["p"] == got[label]).mean()


def test_toxicity_on_held_out_rows(planted):
    docs, labels = planted
    held = toxicity.held_out(5, 0)
    model = toxicity.fit_toxicity(docs, labels.where(~held))
    assert 0 < len(model.index) < 2000
    assert accuracy(toxicity.score_toxicity(docs, model), labels, "toxic", held) > 0.97


def test_only_text_reaches_a_toxicity_score(planted):
    docs, labels = planted
    model = toxicity.fit_toxicity(docs, labels)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 5000, "source": F.lit("x")})
    a = {r.doc_id + 5000: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert a == {r.doc_id: r.score for r in toxicity.score_toxicity(other, model).collect()}


def test_quality_ranking_on_held_out_rows(planted):
    docs, labels = planted
    held = toxicity.held_out(3, 1)
    model = preference.fit_quality(docs, labels.where(~held))
    assert accuracy(preference.score_quality(docs, model), labels, "quality", held) > 0.97


def test_rules_on_rows_not_sampled(planted):
    docs, labels = planted
    rules = quality_rules.fit_rules(docs, labels, sample_rows=500)
    assert 1 <= len(rules) <= 12 and all(c.statistic in quality_rules.STATISTICS for r in rules for c in r)
    got = quality_rules.apply_rules(quality_rules.text_counts(docs), rules).join(labels, "doc_id").toPandas()
    assert (got["kept"] == (got["quality"] == 1)).mean() > 0.97
    assert (got["rule"].notna() <= ~got["kept"]).all()


def test_rules_read_the_same_in_spark_and_numpy(planted):
    docs, _ = planted
    rule = (quality_rules.Condition("word_length", True, 4.0), quality_rules.Condition("n_words", False, 100.0))
    got = quality_rules.text_counts(docs).select("*", quality_rules.verdict([rule]).alias("v"), *(F.expr(e).alias(f"s_{n}") for n, e in quality_rules.STATISTICS.items())).toPandas()
    want = quality_rules.rule_holds(rule, {n: got[f"s_{n}"].to_numpy().astype(float) for n in quality_rules.STATISTICS})
    assert (got["v"].notna() == want).all() and want.any() and not want.all()


def brute_counts(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(x.strip(quality_rules.BLANKS)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in quality_rules.SYMBOLS for c in text), dup, len(covered)


@pytest.mark.parametrize("text", [None, "", " \n\n ", "a b c a b c", "a a a a", "a b", "x y\nx y\n x y\nx y\n\n\n", "é#ü $%& <|> *\x0b\x0c漢 字 z", "p q r s p q r t q r s p"])
def test_counts_equal_brute_force(text):
    assert quality_rules.count_text(text)[:5] == brute_counts(text)


def test_mixing_meets_its_targets(planted):
    docs, labels = planted
    domains = labels.select("doc_id", F.when(F.col("quality") == 1, "fine").otherwise("bad").alias("domain"))
    targets = {"fine": 0.97, "bad": 0.03}
    got = mixing.mixing_rates(docs, domains, targets).toPandas()
    assert (got["rate"] >= 0).all()
    totals = np.array([(got["n_tokens"] * got[f"p_{d}"] * got["rate"]).sum() for d in targets])
    assert np.allclose(totals / got["n_tokens"].sum(), list(targets.values()), atol=1e-5)
    assert np.allclose(got["p_fine"] + got["p_bad"], 1)


def test_rates_that_hit_zero_stay_nonnegative_and_agree_with_the_column(spark):
    draw = np.random.default_rng(4)
    p = draw.dirichlet([0.4, 0.4, 0.4], 400)
    frame = spark.createDataFrame([(i, int(n), *map(float, x)) for i, (n, x) in enumerate(zip(draw.integers(1, 500, 400), p))], "doc_id long, n_tokens long, p_a double, p_b double, p_c double")
    targets = {"a": 0.9, "b": 0.1, "c": 0.0}
    steps = mixing.fit_steps(frame, targets)
    rate = np.array([r.rate for r in frame.select(mixing.rate_column(list(targets), steps).alias("rate"), "doc_id").orderBy("doc_id").collect()])
    assert np.allclose(rate, mixing.rates_of(p, steps)) and rate.min() == 0.0
    tokens = np.array([r.n_tokens for r in frame.orderBy("doc_id").collect()])
    start, end = (np.abs((tokens * r) @ p - tokens.sum() * np.array([0.9, 0.1, 0.0])).max() for r in (np.ones(400), rate))
    assert end < 0.2 * start


def test_messy(messy, messy_rows, messy_labels):
    n = len(messy_rows)
    assert toxicity.score_toxicity(messy, toxicity.fit_toxicity(messy, messy_labels)).where("score BETWEEN 0 AND 1").count() == n
    assert preference.score_quality(messy, preference.fit_quality(messy, messy_labels)).where("score BETWEEN 0 AND 1").count() == n
    rules = quality_rules.quality_rules(messy, messy_labels)
    assert rules.where("kept IS NOT NULL").count() == n and not any(r.kept for r in rules.where("n_words = 0").collect())
    domains = messy_labels.select("doc_id", F.when(F.col("quality") == 1, "clean").when(F.col("quality") == 0, "junk").alias("domain"))
    assert mixing.mixing_rates(messy, domains, {"clean": 0.9, "junk": 0.1}).where("rate >= 0").count() == n
    assert set(mixing.mixed_documents(messy, domains, {"clean": 0.9, "junk": 0.1}).columns) == set(messy.columns)


def test_without_labels(messy, messy_rows, nothing):
    none, n = nothing[1], len(messy_rows)
    assert {r.score < 1e-9 for r in toxicity.score_toxicity(messy, toxicity.fit_toxicity(messy, none)).collect()} == {True}
    assert {round(r.score, 9) for r in preference.score_quality(messy, preference.fit_quality(messy, none)).collect()} == {0.5}
    got = quality_rules.quality_rules(messy, none).collect()
    assert len(got) == n and all(r.kept != r.base_failed for r in got)
    domains = none.select("doc_id", F.lit("clean").alias("domain"))
    assert {r.p_clean for r in mixing.mixing_rates(messy, domains, {"clean": 1.0, "junk": 1.0}).collect()} == {0.5}


def test_without_documents(nothing):
    docs, labels = nothing
    assert toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).count() == 0
    assert toxicity.split_toxic(docs, labels).count() == 0
    assert preference.score_quality(docs, preference.fit_quality(docs, labels)).count() == 0
    assert quality_rules.quality_rules(docs, labels).count() == 0
    assert mixing.mixing_rates(docs, labels.select("doc_id", F.lit("clean").alias("domain")), {"clean": 1.0}).count() == 0
