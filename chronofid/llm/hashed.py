"""Hashed word features and follow-the-regularised-leader training, for the classifiers on words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.llm.text import chunks, folded_words, many_word_hashes, mixed

#: Distances between the two words of a pair: neighbours, and pairs that skip one or two words.
GAPS = (1, 2, 3)
#: A feature is a 32-bit number; its upper bits index a table that rules most features out.
SCREEN_BITS = 22


def _segments(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def features(lists: list[list[bytes]], gaps: tuple[int, ...] = GAPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text number, feature)`` arrays, one pair for single words and one for each gap; repeats included."""
    hashes, starts = many_word_hashes(lists)
    owner = _segments(starts)
    yield owner, (mixed(hashes) >> np.uint64(32)).astype(np.uint32)
    for gap in gaps:
        same = owner[:-gap] == owner[gap:] if len(owner) > gap else np.zeros(0, bool)
        first, second = hashes[:-gap][same], hashes[gap:][same]
        yield owner[: len(same)][same], (mixed(mixed(first + np.uint64(gap)) + second) >> np.uint64(32)).astype(np.uint32)


@dataclass(frozen=True)
class Weights:
    """The nonzero weights of a model, by sorted feature number."""

    bias: float
    index: np.ndarray
    weight: np.ndarray

    def screen(self) -> np.ndarray:
        table = np.zeros(1 << SCREEN_BITS, bool)
        table[self.index >> np.uint32(32 - SCREEN_BITS)] = True
        return table


def margins(lists: list[list[bytes]], models: list[Weights], screens: list[np.ndarray], gaps: tuple[int, ...] = GAPS) -> np.ndarray:
    """Bias plus the weights of the distinct features of each text, a column for each model."""
    out = np.tile([m.bias for m in models], (len(lists), 1)).astype(float)
    found: list[list[np.ndarray]] = [[] for _ in models]
    for owner, feature in features(lists, gaps):
        upper = feature >> np.uint32(32 - SCREEN_BITS)
        for k, screen in enumerate(screens):
            maybe = screen[upper]
            found[k].append((owner[maybe].astype(np.uint64) << np.uint64(32)) | feature[maybe])
    for k, model in enumerate(models):
        if not len(model.index):
            continue
        pairs = np.unique(np.concatenate(found[k]))
        feature = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.minimum(np.searchsorted(model.index, feature), len(model.index) - 1)
        known = model.index[at] == feature
        owner = (pairs[known] >> np.uint64(32)).astype(np.int64)
        out[:, k] += np.bincount(owner, model.weight[at[known]], len(lists))
    return out


def sampled_features(docs: DataFrame, extra: str, gaps: tuple[int, ...] = GAPS, split=folded_words) -> DataFrame:
    """``extra`` and the distinct features (as bytes) of one row per ``doc_id``, for a sample of few ids.

    Rows that share an id are settled before they meet: each task keeps the one with the smallest features.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                packed = []
                for text in texts:
                    parts = [f for _, f in features([split(text)], gaps)]
                    packed.append(np.unique(np.concatenate(parts)).tobytes())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column(extra), pa.array(packed, pa.binary())], names=["doc_id", extra, "features"])

    rows = docs.select("doc_id", extra, "text").mapInArrow(run, f"doc_id {id_type}, {extra} int, features binary")
    return rows.groupBy("doc_id").agg(F.min(F.struct("features", extra)).alias("one")).select(f"one.{extra}", "one.features")


def feature_rows(chunks_: list[pa.Array]) -> list[np.ndarray]:
    """The rows of ``sampled_features``, without copying them."""
    return [np.frombuffer(x.as_buffer(), np.uint32) for chunk in chunks_ for x in chunk]


def shared_features(rows: list[np.ndarray], min_docs: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features that at least ``min_docs`` rows have, and each row's places among them."""
    # Counts by the upper bits are never too low, so they rule out most of the rare features cheaply.
    seen = np.zeros(1 << 26, np.uint8)
    for row in rows:
        upper = row >> np.uint32(6)
        seen[upper] = np.minimum(seen[upper], 254) + 1
    rows = [row[seen[row >> np.uint32(6)] >= min(min_docs, 255)] for row in rows]
    # Rows are sorted, so a slice of the numbers is a stretch of each row: one slice is counted at a time.
    edges = np.arange(0, (1 << 32) + 1, 1 << 28, dtype=np.uint64)
    cuts = [np.searchsorted(row, edges) for row in rows]
    found = [np.zeros(0, np.uint32)]
    for k in range(len(edges) - 1):
        part = [row[cut[k] : cut[k + 1]] for row, cut in zip(rows, cuts)]
        number, times = np.unique(np.concatenate(part), return_counts=True) if part else (found[0], np.zeros(0, int))
        found.append(number[times >= min_docs])
    known = np.concatenate(found)
    places = []
    for row in rows:
        at = np.searchsorted(known, row)
        at[at == len(known)] = 0
        places.append((at[known[at] == row] if len(known) else at[:0]).astype(np.int32))
    return known, places


def fit_ftrl(
    known: np.ndarray, rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 4, seed: int = 5
) -> Weights:
    """Logistic regression by FTRL-proximal: a learning rate for each coordinate, and L1 that keeps most at zero.

    ``rows`` holds the places of each row's features in ``known``; the last coordinate is the bias, without L1.
    """
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    penalty = np.full(len(known) + 1, l1)
    penalty[-1] = 0.0
    rate = lambda part: (beta + np.sqrt(n[part])) / alpha + l2

    def weights(part) -> np.ndarray:
        return np.where(np.abs(z[part]) <= penalty[part], 0.0, -(z[part] - np.sign(z[part]) * penalty[part]) / rate(part))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            part = np.append(rows[i], len(known))
            w = weights(part)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            sigma = (np.sqrt(n[part] + gradient**2) - np.sqrt(n[part])) / alpha
            z[part] += gradient - sigma * w
            n[part] += gradient**2
    w = weights(np.arange(len(known) + 1))
    used = np.flatnonzero(w[:-1])
    return Weights(float(w[-1]), known[used], w[used])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
