"""Score document quality by pairwise ranking, in the manner of Bradley and Terry.

Method. Each text becomes a short vector of statistics, cut into steps at the quantiles of both classes so that a score may
bend. All labelled rows are learned from: a row of label 1 is preferred to the rows of label 0 that share its block.
Rows are dealt to blocks in the order of their steps, each class by itself; if one class has fewer rows than there are blocks, its
rows come again, so every row meets the other class. Newton steps on the logistic loss of feature differences give one weight per
step: the strength of a document is its weighted sum. Tasks sum slope and curvature over their blocks; the driver sees the sums
alone. The threshold is a quantile of the strengths of all labelled rows: the share of label 0 lies below it.
The score is the logistic function of the distance to the threshold, so 0.5 is the threshold.

Defined cases. A null or empty text has the statistics of no words and is scored like any other. Rows with a null
label are not learned from; of several labels for one ``doc_id`` the largest counts. Without labelled rows of both
classes every score is the share of label 1 (0.5 if there are none). Repeated rows are scored one by one. Columns
beyond ``doc_id`` and ``text`` never reach a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.llm.hashed import sigmoid
from chronofid.llm.quality_rules import COUNTS, count_text
from chronofid.llm.text import chunks
from chronofid.operators.ordered import ordered
from chronofid.session import checkpointed

#: What all pairs weigh together against the penalty, and steps that each statistic is cut into at most by either class.
PAIRS, STEPS = 40_000, 8
#: Rows of the larger class in a block, and rows of the curvature that are summed in one piece.
BLOCK_ROWS, BAND = 256, 32
STATISTICS = [
    "log_words", "word_length", "symbol_rate", "mark_rate", "upper_share", "digit_share", "dup_line_share",
    "repeat_share", "words_per_line", "distinct_share", "same_as_previous", "longest_word",
]


def text_statistics(text: str | None) -> list[float]:
    count = dict(zip(COUNTS, count_text(text)))
    listed = (text or "").encode().split()
    n, chars, lines = max(1, count["n_words"]), max(1, count["word_chars"]), max(1, count["n_lines"])
    return [
        float(np.log1p(count["n_words"])), count["word_chars"] / n, count["n_symbols"] / n, count["n_marks"] / n,
        count["n_upper"] / chars, count["n_digits"] / chars, count["n_dup_lines"] / lines, count["n_repeat_words"] / n,
        n / lines, len(set(listed)) / n, sum(a == b for a, b in zip(listed, listed[1:])) / n, float(max(map(len, listed), default=0)),
    ]


@dataclass(frozen=True)
class Strength:
    """Steps (statistic, limit), a weight for passing each, the threshold and the scale of strengths."""

    statistic: np.ndarray
    limit: np.ndarray
    weight: np.ndarray
    threshold: float
    scale: float

    def of(self, x: np.ndarray) -> np.ndarray:
        return strengths(steps(x, self.statistic, self.limit), self.weight)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((self.of(x) - self.threshold) / self.scale)


def steps(x: np.ndarray, statistic: np.ndarray, limit: np.ndarray) -> np.ndarray:
    return (x[:, statistic] > limit).astype(float)


def strengths(f: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums, rounded so that equal rows keep equal strengths whatever batch they come in."""
    return np.round(f @ weight, 9)


def newton(sums, size: int, l2: float, rounds: int) -> np.ndarray:
    """Weights at which the loss plus the penalty ``l2 / 2 * |w|^2`` is least; ``sums(w)`` is the slope and curvature over all pairs."""
    w = np.zeros(size)
    for _ in range(rounds):
        slope, curve = sums(w)
        move = np.linalg.solve(curve + l2 * np.eye(size), slope - l2 * w)
        w += move
        if np.abs(move).max() < 1e-6:
            break
    return w


def fit_strength(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = 1.0, rounds: int = 25, seed: int = 3) -> Strength:
    """Weights from drawn pairs of rows in memory; ``y`` is 1 for preferred rows. ``fit_quality`` learns from whole tables."""
    cuts = []
    for k in range(x.shape[1]):
        # Cut where either class has its quantiles, so that a rare class gets steps too.
        both = np.concatenate([np.quantile(x[y == c, k], np.linspace(0, 1, STEPS + 1), method="lower") for c in (0, 1)])
        cuts += [(k, c) for c in np.unique(both)]
    statistic, limit = np.array([k for k, _ in cuts]), np.array([c for _, c in cuts])
    f = steps(x, statistic, limit)
    draw = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = f[draw.choice(good, pairs)] - f[draw.choice(bad, pairs)]

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        miss = sigmoid(-(d @ w))
        return d.T @ miss, (d * (miss * (1 - miss))[:, None]).T @ d

    w = newton(sums, d.shape[1], l2, rounds)
    ordered_ = np.sort(strengths(f, w))
    at = int(round((y == 0).mean() * len(ordered_)))
    threshold = (ordered_[max(0, at - 1)] + ordered_[min(at, len(ordered_) - 1)]) / 2
    return Strength(statistic, limit, w, float(threshold), 1.0)


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, statistics`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                x = np.array([text_statistics(t) for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), lists], names=["doc_id", "statistics"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, statistics array<double>")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("statistics").flatten().to_numpy().reshape(batch.num_rows, len(STATISTICS))


def _at_ranks(values: DataFrame, keys: list[str], value: str, ranks: Column, rows: int) -> DataFrame:
    """Of each key, the values that stand at ``ranks`` (an array, from 0) in ascending order."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = ordered(counts, keys, [value], rows).running(_upto="_n").result()
    return upto.where(F.exists(ranks, lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto"))))


def _cuts(rows: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Statistic and limit of every step: where either class has its quantiles, so that a rare class gets steps too."""
    long = rows.select("label", F.posexplode("statistics").alias("k", "value"))
    ranks = {c: F.array(*[F.lit((n - 1) * i // STEPS).cast("long") for i in range(STEPS + 1)]) for c, n in sizes.items()}
    found = _at_ranks(long, ["label", "k"], "value", F.when(F.col("label") == 1, ranks[1]).otherwise(ranks[0]), sum(sizes.values()) * len(STATISTICS))
    cuts = sorted({(r["k"], r["value"]) for r in found.select("k", "value").collect()})
    return np.array([k for k, _ in cuts]), np.array([c for _, c in cuts])


def _coded(rows: DataFrame, statistic: np.ndarray, limit: np.ndarray) -> DataFrame:
    """``label, code``: per statistic, a byte that counts the steps passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            code = np.column_stack([np.searchsorted(limit[statistic == k], x[:, k], "left") for k in range(x.shape[1])]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([c.tobytes() for c in code], pa.binary())], names=["label", "code"])

    return rows.select("label", "statistics").mapInArrow(run, "label int, code binary")


def _steps_of(codes: list[bytes], statistic: np.ndarray) -> np.ndarray:
    """``steps`` from codes."""
    code = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), len(STATISTICS))
    step = np.arange(len(statistic)) - np.searchsorted(statistic, statistic)
    return (code[:, statistic] > step).astype(float)


def _blocks(coded: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """``good, bad``: codes of the rows that meet. Every row is in one block, those of a class of fewer rows than blocks in several."""
    count = -(-max(sizes.values()) // BLOCK_ROWS)
    # Equal codes may change places, so their order need not be settled.
    dealt = ordered(coded, ["label"], ["code"], sum(sizes.values())).numbered("at").result()
    of_class = {c: F.array(F.col("at") % count) if n >= count else F.sequence("at", F.lit(count - 1).cast("long"), F.lit(n).cast("long")) for c, n in sizes.items()}
    placed = dealt.select("label", "code", F.explode(F.when(F.col("label") == 1, of_class[1]).otherwise(of_class[0])).alias("block"))
    side = lambda c: F.array_sort(F.collect_list(F.when(F.col("label") == c, F.col("code"))))
    blocks = placed.groupBy("block").agg(side(1).alias("good"), side(0).alias("bad"))
    return blocks.repartition(min(count, max(coded.sparkSession.sparkContext.defaultParallelism, count // 64)), "block")


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and curvature of the logistic loss over all pairs of a preferred row and another, which weigh as much as the larger side has rows."""
    miss = sigmoid((bad @ w)[None, :] - (good @ w)[:, None])
    bend, weight = miss * (1 - miss), 1 / min(len(good), len(bad))
    across = good.T @ (bend @ bad)
    curve = (good * bend.sum(axis=1)[:, None]).T @ good + (bad * bend.sum(axis=0)[:, None]).T @ bad - across - across.T
    return weight * (good.T @ miss.sum(axis=1) - bad.T @ miss.sum(axis=0)), weight * curve


def _sums_over(blocks: DataFrame, statistic: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pair_sums`` over all blocks: tasks add up theirs, then pieces of the table are added up across tasks."""
    size = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            for good, bad in zip(batch.column("good").to_pylist(), batch.column("bad").to_pylist()):
                slope, curve = pair_sums(_steps_of(good, statistic), _steps_of(bad, statistic), w)
                total[0] += slope
                total[1:] += curve
        task, bands = TaskContext.get().partitionId(), range(0, size + 1, BAND)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(bands), pa.int32()), pa.array([task] * len(bands), pa.int32()), pa.array([total[b : b + BAND].tobytes() for b in bands], pa.binary())],
            names=["band", "task", "sums"],
        )

    def add(band: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s) for s in band.sort_values("task")["sums"])
        return pd.DataFrame({"band": band["band"].iloc[:1], "sums": [total.tobytes()]})

    parts = blocks.select("good", "bad").mapInArrow(run, "band int, task int, sums binary").groupBy("band").applyInPandas(add, "band int, sums binary")
    total = np.frombuffer(b"".join(r["sums"] for r in sorted(parts.collect(), key=lambda r: r["band"]))).reshape(size + 1, size)
    return total[0], total[1:]


def _threshold(coded: DataFrame, statistic: np.ndarray, w: np.ndarray, sizes: dict[int, int]) -> float:
    """Between the strengths below which label 0 would lie if it had the lowest ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(strengths(_steps_of(batch.column("code").to_pylist(), statistic), w))], names=["strength"])

    ranks = F.array(*[F.lit(r).cast("long") for r in (sizes[0] - 1, sizes[0])])
    found = _at_ranks(coded.select("code").mapInArrow(run, "strength double"), [], "strength", ranks, sum(sizes.values()))
    both = [r["strength"] for r in found.select("strength").collect()]
    return (min(both) + max(both)) / 2


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", l2: float = 1.0, rounds: int = 25, statistics: DataFrame | None = None) -> Strength:
    """Learn from all rows of ``labels`` (``doc_id`` and the 0/1 column ``label``). ``statistics`` may hold ``described(docs)``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = checkpointed((described(docs) if statistics is None else statistics).join(known, "doc_id").where("label IN (0, 1)").select("label", "statistics"))
    sizes = {c: 0 for c in (0, 1)} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not all(sizes.values()):
        none = np.zeros(0, int)
        share = float(np.clip(sizes[1] / sum(sizes.values()) if any(sizes.values()) else 0.5, 1e-15, 1 - 1e-15))
        return Strength(none, np.zeros(0), np.zeros(0), -float(np.log(share / (1 - share))), 1.0)
    statistic, limit = _cuts(rows, sizes)
    coded = checkpointed(_coded(rows, statistic, limit))
    blocks = checkpointed(_blocks(coded, sizes))
    scale = PAIRS / max(sizes.values())

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slope, curve = _sums_over(blocks, statistic, w)
        return scale * slope, scale * curve

    w = newton(sums, len(statistic), l2, rounds)
    return Strength(statistic, limit, w, _threshold(coded, statistic, w, sizes), 1.0)


def score_quality(docs: DataFrame, model: Strength, statistics: DataFrame | None = None) -> DataFrame:
    """``doc_id, score`` of every document. ``statistics`` may hold ``described(docs)``."""
    rows = described(docs) if statistics is None else statistics
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(_matrix(batch)))], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
