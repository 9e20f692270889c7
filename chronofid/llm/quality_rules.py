"""Keep or reject documents by a fixed base rule and a learned list of readable threshold rules.

Method. Per document a handful of counts (``STATISTICS``) is taken from the whole text. On a bounded sample of
labelled rows, sequential covering learns rules for the rejected class: a rule grows, one threshold at a time,
by information gain over the rows that earlier rules leave, and is pruned from its end on rows held back.
A rule that does not hold up on those rows ends the list. The list becomes one chain of Spark ``when``
conditions over the counts, so the verdict of all rows is a plain column expression.

Defined cases. A null or empty text has no words and fails the base rule. Rows with a null label are not
learned from; of several labels for one ``doc_id`` the largest counts. Without labelled rows of both classes
the list is empty and only the base rule decides. Repeated rows each get their own verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofid.llm.text import chunks, mixed, word_hashes, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]

#: Ratios the rules may use, as SQL over the counts.
STATISTICS = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_SYMBOL_BYTES = SYMBOLS.encode()
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"!?.,;:"


def repeated_words(listed: list[bytes], width: int = 3) -> int:
    """Words that lie in a run of ``width`` words found at least twice."""
    n = len(listed)
    if n < width:
        return 0
    _, ids = np.unique(word_hashes(listed), return_inverse=True)
    windows = ids[: n - width + 1].astype(np.uint64)
    for k in range(1, width):
        windows = mixed(windows) + ids[k : n - width + 1 + k].astype(np.uint64)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    starts = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(times[which] > 1)
    np.add.at(starts, hit, 1)
    np.add.at(starts, hit + width, -1)
    return int((np.cumsum(starts[:n]) > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for one text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    listed = raw.split()
    lines = text.split("\n")
    seen, dup = set(), 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line.strip(BLANKS):
            seen.add(line)
    kinds = [len(raw) - len(raw.translate(None, k)) for k in (_SYMBOL_BYTES, _UPPER, _DIGITS, _MARKS)]
    chars = len(text) - sum(map(text.count, BLANKS))
    return (len(listed), chars, kinds[0], dup, repeated_words(listed), len(lines), kinds[1], kinds[2], kinds[3])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch, "text"):
            columns = zip(*map(count_text, texts))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *COUNTS]
            )


def text_counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``COUNTS`` of every document."""
    return docs.select("doc_id", "text").mapInArrow(_count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    limit: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        values = table[self.statistic]
        return values > self.limit if self.above else values <= self.limit

    def sql(self) -> str:
        return f"({STATISTICS[self.statistic]}) {'>' if self.above else '<='} {self.limit!r}D"


Rule = tuple[Condition, ...]


def rule_holds(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(table) for c in rule))


def _candidates(values: np.ndarray, count: int = 32) -> np.ndarray:
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, count + 1)[1:-1], method="lower"))
    above = np.searchsorted(np.unique(values), cuts, "right")
    distinct = np.unique(values)
    inside = above < len(distinct)
    return (cuts[inside] + distinct[above[inside]]) / 2


def _grown(table: dict[str, np.ndarray], bad: np.ndarray, max_length: int) -> Rule:
    """Add the condition with the highest gain until a rule covers rejected rows only, or none gains."""
    inside, rule = np.ones(len(bad), bool), ()
    while len(rule) < max_length and (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        before, best = np.log2(p / (p + n)), (0.0, None)
        for name, values in table.items():
            for limit in _candidates(values[inside]):
                for above in (True, False):
                    hit = inside & (values > limit if above else values <= limit)
                    p1, n1 = (bad & hit).sum(), (~bad & hit).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - before)
                        if gain > best[0] + 1e-9:
                            best = (gain, Condition(name, above, float(limit)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(table)
    return rule


def _worth(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = rule_holds(rule, table)
    p, n = (bad & hit).sum(), (~bad & hit).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn_rules(
    table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, max_rules: int = 12, max_length: int = 4, least: int = 5, seed: int = 11
) -> list[Rule]:
    """Ordered rules for the rejected class, each at least ``precision`` pure on rows held back from growing."""
    rules: list[Rule] = []
    held = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left = np.ones(len(bad), bool)
    while len(rules) < max_rules and (bad & left & ~held).sum() >= least:
        part = lambda mask: ({k: v[mask] for k, v in table.items()}, bad[mask])
        rule = _grown(*part(left & ~held), max_length)
        if not rule:
            break
        options = [rule[:k] for k in range(len(rule), 0, -1)]
        rule = max(options, key=lambda r: _worth(r, *part(left & held)))
        hit = rule_holds(rule, table) & left
        support = (bad & hit & held).sum()
        if support < least or _worth(rule, *part(left & held)) < 2 * precision - 1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, picked by a hash of the id: ``doc_id, label``."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> list[Rule]:
    """Learn from at most ``sample_rows`` rows of ``labels`` (``doc_id``, ``quality``; 0 is rejected)."""
    sample = labelled_sample(labels, "quality", sample_rows)
    rows = text_counts(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left_semi")).join(sample, "doc_id")
    got = rows.where(~base_failed()).select("label", *(F.expr(e).cast("double").alias(n) for n, e in STATISTICS.items())).toPandas()
    bad = got["label"].to_numpy() == 0
    if not bad.any() or bad.all():
        return []
    return learn_rules({n: got[n].to_numpy() for n in STATISTICS}, bad, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that rejects a row, from 1; null if none does."""
    chain = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        chain = F.when(F.expr(" AND ".join(c.sql() for c in rule)), number).otherwise(chain)
    return chain


def apply_rules(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``base_failed``, ``rule`` (the one that rejects) and ``kept``."""
    out = counts.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def quality_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """Counts and verdict of every document."""
    return apply_rules(text_counts(docs), fit_rules(docs, labels, sample_rows))
