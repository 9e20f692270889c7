"""Collocations: phrases of two to four words that occur far more often than their parts would by themselves.

Method. Texts (A-Z in lower case) fall into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words ``[^\\x20\\x09]+``; all counts are per
``lang`` and n-grams never cross a piece.

* First pass: Misra-Gries. Every n-gram of one to four words belongs to a hash partition. A task sends each partition the exact
  counts of a stretch of text (a summary without error); there they are merged into one summary with ``CAPACITY`` times
  mass / threshold counters. A merge above capacity takes the count of the first counter beyond it off all counters, so that in sum less
  than ``min_count / CAPACITY`` is taken off any. A counter with what was taken off bounds the true count from above: whatever
  reaches ``min_count`` survives, whatever cannot is gone.
* Second pass: exact. Occurrences of survivors are counted by their words, so hash collisions add nothing to any count.
* Scores. A candidate of at least ``min_count`` is cut after each of its words; the parts of a candidate are at least as frequent as it,
  so their counts are there. The score is ``floor(2000000 * a / (l + r))`` of the lowest-scoring cut, in decimal
  arithmetic. Candidates inside a longer one that has 80 % of their count go; the best ``top`` of each language stay.

Scale. A partition's header rows carry its mass and come first, so its capacity is fixed before the first counter and its memory follows
mass / threshold, not the number of distinct n-grams. Stretches travel as sorted 32-bit remainders, by differences, compressed. The
number of partitions follows the bytes of text. The second pass tests n-grams against a bit table of the survivors (two of 32 bits
each, at most ``MAX_BITS`` in all; beyond, more n-grams travel and none is lost). Frequent words or phrases are counted where they are before
they travel. The ranking cuts languages by a hash of the phrase first.

Defined cases. Null ``lang`` counts as ``und``, together with texts so marked; null, empty and blank texts have no words. Repeated rows count each
time. Very long texts are read piece by piece, with the last three words carried on. An empty table gives an empty result. Columns
beyond ``lang`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofid.llm.text import chunks, mixed
from chronofid.session import checkpointed

LONGEST = 4
#: Counters of a summary for each ``mass / threshold``.
CAPACITY = 4
#: Text bytes for each hash partition, and partitions at most.
PARTITION_BYTES, MAX_PARTITIONS = 4 << 20, 1 << 18
#: Words counted together, and bytes of a text split into words at a time.
STRETCH, PART = 1 << 19, 1 << 21
#: Counters that wait to be merged, and phrases that a task counts before it sends them on.
WAITING, PHRASES = 1 << 20, 250_000
#: Bits of the table of survivors at most: 128 MB.
MAX_BITS = 1 << 30

#: Marks the end of a piece; no UTF-8 text holds this byte.
_END = b"\xff"
_FOLD = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", _END * 10 + b" ")
_CUT = re.compile(rb"[ \xff]")


@dataclass
class Stretch:
    """Words of some texts in a row, as numbers; 0 ends a piece. The first ``old`` words have been in the stretch before."""

    ids: np.ndarray
    langs: np.ndarray
    words: list[bytes]
    names: list[str]
    old: int

    def hashes(self) -> list[np.ndarray]:
        """For each length 1 to 4, hashes of the n-grams at every start."""
        of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        of_lang = mixed(np.array([xxhash.xxh3_64_intdigest(n.encode()) for n in self.names], np.uint64))
        plain, out = of_word[self.ids], []
        run = mixed(plain + of_lang[self.langs])
        for k in range(LONGEST):
            if k:
                run = mixed(run[:-1]) + plain[k:]
            out.append(mixed(run))
        return out

    def starts(self) -> list[np.ndarray]:
        """For each length, which starts hold an n-gram that lies in one piece and ends in a new word."""
        real, out = self.ids > 0, []
        inside = real
        for k in range(LONGEST):
            if k:
                inside = inside[:-1] & real[k:]
            new = np.arange(len(inside)) + k >= self.old
            out.append(inside & new)
        return out


class _Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[Stretch]:
    """The words of all texts, ``STRETCH`` or a little more at a time."""
    tokens: list[bytes] = []
    spans: list[tuple[int, int]] = []
    names: dict[str, int] = {}
    old = 0

    def settle() -> Stretch:
        numbers = _Numbers({_END: 0})
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
        first = np.array([a for a, _ in spans] + [len(tokens)])
        langs = np.repeat(np.array([n for _, n in spans], np.int32), np.diff(first))
        return Stretch(ids, langs, list(numbers), list(names), old)

    for batch in batches:
        for piece, texts in chunks(batch, "text"):
            for lang, text in zip(piece.column("lang").to_pylist(), texts):
                name = names.setdefault("und" if lang is None else lang, len(names))
                data = (text or "").encode().lower().translate(_FOLD)
                start = 0
                while start < len(data):
                    found = _CUT.search(data, start + PART)
                    end = found.start() if found else len(data)
                    spans.append((len(tokens), name))
                    tokens += data[start:end].replace(_END, b" \xff ").split()
                    start = end
                    if len(tokens) > STRETCH:
                        yield settle()
                        tokens = tokens[1 - LONGEST :]
                        old, spans = len(tokens), [(0, name)]
                if data:
                    tokens.append(_END)
    if len(tokens) > old:
        yield settle()


def packed(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _summaries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Per stretch and hash partition: a header with the mass, then remainders (as differences) and counts."""
    for stretch in stretches(batches):
        hashes = np.concatenate([h[s] for h, s in zip(stretch.hashes(), stretch.starts())]) >> np.uint64(32 - bits)
        keys, counts = np.unique(hashes, return_counts=True)
        place = (keys >> np.uint64(32)).astype(np.int64)
        rest = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        parts, kinds, masses, bodies = [], [], [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            parts += [place[a]] * 2
            kinds += [0, 1]
            masses += [int(counts[a:b].sum()), 0]
            # Counts beyond 32 bits cannot be: a stretch is shorter.
            bodies += [b"", packed(np.concatenate([np.diff(rest[a:b], prepend=0), counts[a:b]]))]
        if parts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array(kinds, pa.int32()), pa.array(masses, pa.int64()), pa.array(bodies, pa.binary())],
                names=["part", "kind", "mass", "body"],
            )


class Summary:
    """A Misra-Gries summary of counted keys: no counter is too low by more than ``error``."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._size += len(keys)
        if self._size > max(WAITING, self.capacity):
            self.settle()

    def settle(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self._waiting))
        self._waiting, self._size = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
        if len(self.keys) > self.capacity:
            beyond = len(self.keys) - self.capacity - 1
            off = int(np.partition(self.counts, beyond)[beyond])
            self.error += off
            keep = self.counts > off
            self.keys, self.counts = self.keys[keep], self.counts[keep] - off

    def survivors(self, least: int) -> np.ndarray:
        """Keys whose true count may be ``least`` or more."""
        self.settle()
        return self.keys[self.counts + self.error >= least]


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Survivors of each hash partition, from rows sorted by (part, kind)."""
    part, mass, summary = None, 0, None

    def settled() -> pa.RecordBatch:
        keys = (summary.survivors(least) if summary else np.zeros(0, np.int64)) | (np.int64(part or 0) << 32)
        return pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "mass")), batch.column("body")):
            if row[0] != part:
                if part is not None:
                    yield settled()
                part, mass, summary = row[0], 0, None
            if row[1] == 0:
                mass += row[2]
                continue
            if summary is None:
                summary = Summary(CAPACITY * mass // least + 1)
            both = unpacked(row[3].as_py()).astype(np.int64)
            half = len(both) // 2
            summary.add(np.cumsum(both[:half]), both[half:])
    if part is not None:
        yield settled()


def partition_bits(docs: DataFrame) -> int:
    """Hash partitions as a power of two, after the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(0, min(MAX_PARTITIONS, size // PARTITION_BYTES) - 1)).bit_length()


def survivors(docs: DataFrame, least: int, bits: int) -> DataFrame:
    """``key``: hashes of all n-grams that may occur ``least`` times in a language, and of few others."""
    sent = docs.select("lang", "text").mapInArrow(partial(_summaries, bits=bits), "part int, kind int, mass long, body binary")
    return sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(partial(_merged, least=least), "key long")


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sums of the counts of each phrase, from rows sorted by (part, lang); those below ``least`` go."""
    at, sums = None, {}

    def settled() -> pa.RecordBatch:
        kept = [(p, n) for p, n in sums.items() if n >= least or not p]
        phrases = pa.array([p for p, _ in kept], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(kept), pa.string()), phrases, pa.array([n for _, n in kept], pa.int64())], names=["lang", "phrase", "f"])

    for batch in batches:
        for part, lang, phrases, counts in zip(*(batch.column(c) for c in ("part", "lang", "phrases", "counts"))):
            if (part.as_py(), lang.as_py()) != at:
                if sums:
                    yield settled()
                at, sums = (part.as_py(), lang.as_py()), {}
            for p, n in zip(zstandard.decompress(phrases.as_py()).split(b"\n"), unpacked(counts.as_py()).tolist()):
                sums[p] = sums.get(p, 0) + n
    if sums:
        yield settled()


def probes(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key in a table of ``size`` bits."""
    both = mixed(keys.astype(np.uint64))
    return ((both & np.uint64(size - 1)).astype(np.int64), (both >> np.uint64(32) & np.uint64(size - 1)).astype(np.int64))


def has_bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


def _rows_of(columns: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First row, and for each row the number, of each distinct (tag, word, ...) row."""
    return np.unique(np.column_stack([tags, columns]), axis=0, return_index=True, return_inverse=True, return_counts=True)[1:]


def _counted(batches: Iterator[pa.RecordBatch], shared, bits: int) -> Iterator[pa.RecordBatch]:
    """Exact counts of the phrases whose hash survived, a row per hash partition and language; the empty phrase counts all words."""
    table = shared.value.view(np.uint64)
    held: dict[tuple[str, bytes], int] = {}
    seen = 0

    def settled() -> pa.RecordBatch:
        groups: dict[tuple[int, str], list[tuple[bytes, int]]] = {}
        for (name, phrase), n in held.items():
            part = xxhash.xxh3_64_intdigest(phrase, len(name)) >> (64 - bits)
            groups.setdefault((part, name), []).append((phrase, n))
        held.clear()
        # No phrase holds a line feed, which ends a piece.
        return pa.RecordBatch.from_arrays(
            [
                pa.array([part for part, _ in groups], pa.int32()),
                pa.array([name for _, name in groups], pa.string()),
                pa.array([zstandard.compress(b"\n".join(p for p, _ in g), 1) for g in groups.values()], pa.binary()),
                pa.array([packed(np.array([n for _, n in g])) for g in groups.values()], pa.binary()),
            ],
            names=["part", "lang", "phrases", "counts"],
        )

    for stretch in stretches(batches):
        seen += len(stretch.ids)
        if seen >> 32:  # counts travel as 32 bits
            yield settled()
            seen = len(stretch.ids)
        hashes, starts = stretch.hashes(), stretch.starts()
        every = np.bincount(stretch.langs[starts[0]], minlength=len(stretch.names))
        for name, n in zip(stretch.names, every.tolist()):
            if n:
                held[name, b""] = held.get((name, b""), 0) + n
        for k in range(LONGEST):
            at = np.flatnonzero(starts[k])
            one, two = probes(hashes[k][at] >> np.uint64(32 - bits), 64 * len(table))
            at = at[has_bit(table, one) & has_bit(table, two)]
            if not len(at):
                continue
            columns = stretch.ids[at[:, None] + np.arange(k + 1)]
            tags = stretch.langs[at]
            _, first, of_row, counts = np.unique(hashes[k][at], return_index=True, return_inverse=True, return_counts=True)
            same = (columns == columns[first][of_row]).all() and (tags == tags[first][of_row]).all()
            if not same:  # two n-grams with one hash: go by the words themselves
                first, of_row, counts = _rows_of(columns, tags)
            for row, tag, n in zip(columns[first].tolist(), tags[first].tolist(), counts.tolist()):
                entry = stretch.names[tag], b" ".join([stretch.words[w] for w in row])
                held[entry] = held.get(entry, 0) + n
            if len(held) > PHRASES:
                yield settled()
    if held:
        yield settled()


def _bits(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(probes(batch.column("key").to_numpy(), size))
        yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.int64(1) << (at & 63))], names=["word", "bits"])


def bit_table(keys: DataFrame) -> np.ndarray:
    """A table with the ``probes`` of each key set; 32 bits a key, within ``MAX_BITS``."""
    size = 1 << max(16, min(MAX_BITS.bit_length() - 1, (32 * keys.count()).bit_length()))
    rows = keys.mapInArrow(partial(_bits, size=size), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.toArrow()
    table = np.zeros(size // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """``lang, phrase, f`` of all phrases of one to four words with ``f >= least``; the empty phrase has the number of all words."""
    bits = partition_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(bit_table(checkpointed(survivors(docs, least, bits))))
    sent = docs.select("lang", "text").mapInArrow(partial(_counted, shared=shared, bits=bits), "part int, lang string, phrases binary, counts binary")
    return sent.repartition("part").sortWithinPartitions("part", "lang").mapInArrow(partial(_summed, least=least), "lang string, phrase string, f long")


def words_between(begin: int, end: int) -> str:
    """SQL of the words number ``begin`` to ``end`` of the array ``ws``."""
    return f"array_join(slice(ws, {begin + 1}, {end - begin}), ' ')"


def collocations(docs: DataFrame, min_count: int = 30, top: int = 2000, salts: int = 64) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best ``top`` phrases of two to four words."""
    counts = checkpointed(phrase_counts(docs, min_count))
    known = counts.where("phrase <> ''")
    grams = known.withColumn("ws", F.split("phrase", " ")).withColumn("k", F.size("ws"))
    candidates = grams.where("k > 1")
    # Phrases inside longer ones, with the largest count among those.
    inner = {k: [(i, i + size) for size in range(2, k) for i in range(k - size + 1)] for k in range(3, LONGEST + 1)}
    arrays = " ".join(f"WHEN k = {k} THEN array({', '.join(words_between(*x) for x in spans)})" for k, spans in inner.items())
    within = candidates.where("k > 2").select("lang", F.explode(F.expr(f"CASE {arrays} END")).alias("phrase"), "f")
    covered = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = candidates.join(covered, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20,0)) < 80 * CAST(f AS DECIMAL(20,0))")
    cut = kept.select("lang", "phrase", "ws", "k", F.col("f").alias("a"), F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    halves = cut.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(ws, 1, cut), ' ')").alias("first"), F.expr("array_join(slice(ws, cut + 1, k - cut), ' ')").alias("rest"))
    of_first = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    of_rest = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = halves.join(of_first, ["lang", "first"]).join(of_rest, ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * 2000000) div (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")
    best = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest).select("lang", "phrase", "a", "low.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    near = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")
