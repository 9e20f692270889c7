"""Fit a rate for each document so that the expected tokens of the domains meet target weights.

Method. A labelled table names the domain of some documents. One sparse logistic model per domain, trained on a
bounded sample of it, gives every document a posterior over the domains: it belongs to all of them in part. With
``a[d, i] = tokens_i * posterior_id`` and the targets ``t``, nonnegative rates ``x`` minimise the least squares
``(a x - t)' inverse(b) (a x - t)``, where ``b = sum_i tokens_i * posterior_i posterior_i'`` puts the domains on one scale.
Projected gradient steps in the metric of the tokens read ``x_i <- max(0, x_i - posterior_i' inverse(b) (a x - t))``;
the curvature is 1 in every direction, so a full step meets the targets at once as long as no rate hits zero.

How it runs. Posteriors are checkpointed once, a few numbers a row. A step is one aggregation over all rows that sends one
sum per domain to the driver; a row's rate follows from the steps so far as a column expression.

Defined cases. A null or empty text has no tokens; it has a rate all the same, which its posterior decides. Rows
of the labelled table without id or domain, or with a domain that has no target, are not learned from; of several
domains for one ``doc_id`` the largest counts. Without labelled rows the posterior is uniform. A domain with no expected
tokens is left out of the fit. Targets that are negative or sum to nothing are refused. Of several rows for a sampled
``doc_id`` one is learned from; ids may be of any type. Repeated rows are weighed one by one. Columns beyond ``doc_id`` and ``text``
don't reach a posterior. Targets that no nonnegative rates can meet are met as nearly as ``STEPS`` steps allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.llm.hashed import Weights, feature_rows, fit_ftrl, margins, sampled_features, shared_features, sigmoid
from chronofid.llm.text import chunks, folded_words
from chronofid.session import checkpointed

SAMPLE_ROWS = 8_000
MIN_DOCS = 5
STEPS, TOLERANCE = 60, 1e-7

_UPPER, _SYMBOLS, _MARKS = bytes(range(65, 91)), b"#*$%&|<>", b"!?.,;:"


def marked_words(text: str | None) -> list[bytes]:
    """Folded words, and made-up words that say how the text looks (case, symbols, repeats, in steps)."""
    listed = folded_words(text)
    raw = (text or "").encode()
    share = lambda kind: min(9, 20 * (len(raw) - len(raw.translate(None, kind))) // max(1, len(raw)))
    looks = (("upper", share(_UPPER)), ("symbols", share(_SYMBOLS)), ("marks", share(_MARKS)), ("distinct", 10 * len(set(listed)) // max(1, len(listed))))
    return listed + [f"\x00{name} {step}".encode() for name, step in looks]


def labelled_domains(labelled: DataFrame, domains: list[str], rows: int) -> DataFrame:
    """At most ``rows`` ids with the number of their domain: ``doc_id, label``."""
    number = F.array_position(F.array(*map(F.lit, domains)), F.col("domain")) - 1
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.max("domain").alias("domain"))
    return known.select("doc_id", number.cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = SAMPLE_ROWS) -> list[Weights]:
    """One model per domain, from at most ``sample_rows`` rows of ``labelled`` (``doc_id``, ``domain``)."""
    sample = F.broadcast(labelled_domains(labelled, domains, sample_rows))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        y = np.concatenate([b.column("label").to_numpy() for b in got]) if got else np.zeros(0)
        known, rows = shared_features(feature_rows([b.column("features") for b in got]), MIN_DOCS)
        for k in range(len(domains)):
            model = fit_ftrl(known, rows, (y == k).astype(float))
            index, weight = np.append(model.index.astype(np.int64), -1), np.append(model.weight, model.bias)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), k, np.int32)), pa.array(index), pa.array(weight)], names=["domain", "index", "weight"])

    # One task learns from the bounded sample, in the order of the features; the driver gets the weights alone.
    features = sampled_features(docs.select("doc_id", "text").join(sample, "doc_id"), "label", (), marked_words)
    got = features.repartition(1).sortWithinPartitions("features", "label").mapInArrow(train, "domain int, index long, weight double").toArrow()
    domain, index, weight = (got.column(n).to_numpy() for n in ("domain", "index", "weight"))
    models = []
    for k in range(len(domains)):
        at, w = index[domain == k], weight[domain == k]
        bias = float(w[at < 0][0]) if len(at) else 0.0
        models.append(Weights(bias, at[at >= 0].astype(np.uint32), w[at >= 0]))
    return models


def posterior_columns(domains: list[str]) -> list[str]:
    return [f"p_{d}" for d in domains]


def posteriors(listed: list[list[bytes]], models: list[Weights], screens: list[np.ndarray]) -> np.ndarray:
    odds = sigmoid(margins(listed, models, screens, ()))
    return odds / odds.sum(axis=1, keepdims=True)


def domain_posteriors(docs: DataFrame, models: list[Weights], domains: list[str]) -> DataFrame:
    """All columns of ``docs`` but the text, ``n_tokens`` and a posterior column for each domain."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = ["doc_id", "n_tokens", *posterior_columns(domains)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        screens = [m.screen() for m in weights]
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                listed = [marked_words(t) for t in texts]
                odds = posteriors(listed, weights, screens)
                looks = len(marked_words(None))
                columns = [piece.column("doc_id"), pa.array([len(x) - looks for x in listed], pa.int64()), *map(pa.array, odds.T)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, " + ", ".join(f"`{n}` double" for n in names[2:]))


def rate_column(domains: list[str], steps: list[list[float]]) -> Column:
    """The rate after the given steps, each one number per domain."""
    rate = F.lit(1.0)
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"`{p}`") * s for p, s in zip(posterior_columns(domains), step)), F.lit(0.0)))
    return rate


def rates_of(posteriors: np.ndarray, steps: list[list[float]]) -> np.ndarray:
    """``rate_column`` for an array with a row per document."""
    rate = np.ones(len(posteriors))
    for step in steps:
        rate = np.maximum(0.0, rate - posteriors @ np.array(step))
    return rate


def fit_steps(members: DataFrame, targets: dict[str, float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The gradient steps of the rates, over rows of ``n_tokens`` and posteriors; ``targets`` are relative weights."""
    if min(targets.values(), default=0) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must be nonnegative and sum to more than 0")
    names = [F.col(f"`{p}`") for p in posterior_columns(list(targets))]
    tokens = F.col("n_tokens")
    share = np.array(list(targets.values()), float) / sum(targets.values())
    first = members.agg(*(F.sum(tokens * p).alias("m") for p in names), *(F.sum(tokens * p * q).alias("b") for p in names for q in names)).first()
    now, curvature = np.array([x or 0.0 for x in first[: len(names)]]), np.array([x or 0.0 for x in first[len(names) :]]).reshape(len(names), -1)
    want, inverse = share * now.sum(), np.linalg.pinv(curvature, rcond=1e-9, hermitian=True)
    taken: list[list[float]] = []
    while len(taken) < steps and np.abs(now - want).max() > tolerance * want.sum():
        taken.append([float(x) for x in inverse @ (now - want)])
        rate = rate_column(list(targets), taken)
        now = np.array([x or 0.0 for x in members.agg(*(F.sum(tokens * rate * p) for p in names)).first()])
    return taken


def fitted(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample_rows: int) -> tuple[list[Weights], DataFrame, list[list[float]]]:
    """The domain models, every document's posteriors (checkpointed) and the steps of the rates."""
    models = fit_domains(docs, labelled, list(targets), sample_rows)
    members = checkpointed(domain_posteriors(docs, models, list(targets)))
    return models, members, fit_steps(members, targets)


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, n_tokens``, a posterior per domain and ``rate`` of every document."""
    _, members, steps = fitted(docs, labelled, targets, sample_rows)
    return members.withColumn("rate", rate_column(list(targets), steps))


def mixed_documents(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, each as often as its rate says: rounded up or down by a fixed draw from its id and text, so 0 times or more."""
    models, _, steps = fitted(docs, labelled, targets, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        screens = [m.screen() for m in weights]
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                rate = rates_of(posteriors([marked_words(t) for t in texts], weights, screens), steps)
                draw = np.array([xxhash.xxh3_64_intdigest(f"{i} {t or ''}") / 2**64 for i, t in zip(piece.column("doc_id").to_pylist(), texts)])
                yield piece.take(pa.array(np.repeat(np.arange(len(texts)), np.floor(rate + draw).astype(int))))

    return docs.mapInArrow(run, docs.schema)
