"""Score documents for toxicity with a sparse logistic regression on hashed words and word pairs.

Method. Features of a text are its distinct single words, neighbouring pairs and pairs that skip one or two
words, each hashed to 32 bits (A-Z lower-cased, ASCII punctuation read as space). FTRL-proximal training on a
bounded sample of labelled rows gives every coordinate its own rate and, by L1, leaves most weights at zero;
the few that remain are broadcast (``max_weights`` at most) and applied to the whole of every text in one pass without a shuffle.

The sample is drawn by class: a rare class gets ``CLASS_SHARE`` of it, or all its rows if it has fewer. The bias is then
moved by the log odds between the shares of the labelled table and those of the sample, so that scores keep to the table's.

Defined cases. A null or empty text has no features; its score is that of the bias. Rows with a null label are
not learned from; of several labels for one ``doc_id`` the largest counts, and of several rows for a
sampled ``doc_id`` one is learned from. Ids may be of any type. Without labelled rows of both
classes every score is the share of label 1 (0 if there are none). Repeated rows are scored one by one. Columns
beyond ``doc_id`` and ``text`` never reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.llm.hashed import Weights, feature_rows, fit_ftrl, margins, sampled_features, shared_features, sigmoid
from chronofid.llm.text import chunks, folded_words

#: Labelled rows to learn from at most.
SAMPLE_ROWS = 20_000
#: Least share of the sample for each class that has so many rows.
CLASS_SHARE = 0.25
#: Features of fewer sampled rows than this say too little and are left out.
MIN_DOCS = 5
#: Weights kept at most, the largest; with 12 bytes each this bounds the broadcast.
MAX_WEIGHTS = 200_000


def held_out(folds: int, fold: int) -> Column:
    """True for rows that must not be learned from: crc32 of the id as text, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def class_sample(labels: DataFrame, label: str, rows: int, share: float = CLASS_SHARE) -> tuple[DataFrame, float]:
    """At most ``rows`` labelled ids (``doc_id, label``), picked by class and a hash of the id, and the log odds that this adds to label 1."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = known.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") != 1)).first()
    ones, others = (n or 0 for n in counts)
    least = int(rows * share)
    even = round(rows * ones / max(1, ones + others))
    want = min(ones, max(even, least, rows - others), rows - min(others, least))
    rest = min(others, rows - want)
    order = (F.xxhash64("doc_id"), "doc_id")
    picked = known.where("label = 1").orderBy(*order).limit(want).unionByName(known.where("label <> 1").orderBy(*order).limit(rest))
    added = np.log(want / rest) - np.log(ones / others) if want and rest else 0.0
    return picked, float(added)


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, **options) -> Weights:
    """Learn from at most ``sample_rows`` rows of ``labels`` (``doc_id`` and the 0/1 column ``label``)."""
    picked, added = class_sample(labels, label, sample_rows)
    sample = F.broadcast(picked)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        y = (np.concatenate([b.column("label").to_numpy() for b in got]) == 1).astype(float) if got else np.zeros(0)
        if len(y) == 0 or y.min() == y.max():
            share = y.mean() if len(y) else 0.0
            model = Weights(float(np.clip(np.log(max(share, 1e-15) / max(1 - share, 1e-15)), -35, 35)), np.zeros(0, np.uint32), np.zeros(0))
        else:
            known, rows = shared_features(feature_rows([b.column("features") for b in got]), MIN_DOCS)
            model = fit_ftrl(known, rows, y, **options)
        largest = np.sort(np.argsort(-np.abs(model.weight), kind="stable")[:MAX_WEIGHTS])
        index = np.append(model.index[largest].astype(np.int64), -1)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(np.append(model.weight[largest], model.bias - added))], names=["index", "weight"])

    # The sample is bounded, so one task can learn from it; the driver gets the weights alone. Its rows come in the
    # order of their features, whatever task they were made in.
    features = sampled_features(docs.select("doc_id", "text").join(sample, "doc_id"), "label")
    got = features.repartition(1).sortWithinPartitions("features", "label").mapInArrow(train, "index long, weight double").toArrow()
    index, weight = got.column("index").to_numpy(), got.column("weight").to_numpy()
    if not len(index):
        return Weights(-35.0, np.zeros(0, np.uint32), np.zeros(0))
    return Weights(float(weight[index < 0][0]), index[index >= 0].astype(np.uint32), weight[index >= 0])


def score_toxicity(docs: DataFrame, model: Weights) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, screen = shared.value, shared.value.screen()
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                score = sigmoid(margins([folded_words(t) for t in texts], [weights], [screen])[:, 0])
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def split_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """All columns of ``docs`` for the rows whose score stays below ``limit``."""
    model = fit_toxicity(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, screen = shared.value, shared.value.screen()
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                fine = sigmoid(margins([folded_words(t) for t in texts], [weights], [screen])[:, 0]) < limit
                yield piece.filter(pa.array(fine))

    return docs.mapInArrow(run, docs.schema)
