"""Drop lines that many documents share, by probing sharded minimal perfect hash arrays.

Method. A first pass counts, per 128-bit line hash, the documents that hold the line and the largest
``doc_id`` among them; counts of one task are added up before the shuffle. The distinct hashes that reach
``min_docs`` go into shards of bounded size. Each shard is a minimal perfect hash (levels of bit arrays: a
key's place is the rank of its bit) over three arrays: fingerprint, count and keeper. The lines of the
documents stream through the shard they fall in, and only places of lines to drop go back to the texts.
A shard is the only thing a task holds; a hot line is dealt over ``SALTS`` copies of its shard.

Defined cases. A null or empty text is one empty line. Every row counts as a document of its own (a repeated
row counts again); all rows of the largest ``doc_id`` keep the line. Rows without a ``doc_id`` count as
documents and never are the largest, unless no holder has an id: then the line stays everywhere. An empty
table gives an empty result. Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.llm.text import chunks, mixed
from chronofid.session import checkpointed

BLANK = " \t\n\x0b\x0c\r"
#: Copies of each shard that its lines are dealt over.
SALTS = 8
#: Shards at least, so that small indexes still spread; each holds about SHARD_KEYS lines at most.
MIN_SHARDS, SHARD_KEYS = 64, 32_768
#: Bits per key at each level of a minimal perfect hash.
LOAD = 2

_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def line_key(line: str) -> str:
    return line.strip(BLANK).translate(_UPPER)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys; other keys get any place, or -1."""

    def __init__(self, bits: list[np.ndarray], before: list[np.ndarray]) -> None:
        self.bits, self.before = bits, before

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        bits, before, placed = [], [], 0
        left = np.unique(keys)
        while len(left):
            size = LOAD * len(left) + 1
            at = cls._at(left, len(bits), size)
            taken = np.bincount(at, minlength=size)
            alone = taken == 1
            bits.append(alone)
            before.append(placed + np.cumsum(alone) - alone)
            placed += int(alone.sum())
            left = left[~alone[at]]
        return cls(bits, before)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64(level * 0x632BE59BD9B4E019 % 2**64)) % np.uint64(size)).astype(np.int64)

    def packed(self) -> tuple[bytes, bytes]:
        """Level sizes and bits, for ``unpacked``."""
        sizes = np.array([len(b) for b in self.bits], np.int64)
        return sizes.tobytes(), np.packbits(np.concatenate(self.bits)).tobytes()

    @classmethod
    def unpacked(cls, sizes: bytes, packed: bytes) -> PerfectHash:
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        flat = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(ends[-1])).astype(bool)
        rank = np.cumsum(flat) - flat
        return cls(np.split(flat, ends[:-1]), np.split(rank, ends[:-1]))

    def places(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before)):
            at = self._at(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = before[at[hit]]
            open_ = open_[~hit]
        return out


def _lines(min_chars: int, emit):
    """A map over Arrow batches that hands pieces of bounded text to ``emit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                yield from emit(piece, texts, min_chars)

    return run


def _keys(text: str | None, min_chars: int) -> Iterator[tuple[int, int]]:
    """Place and 128-bit hash of each line whose key is long enough."""
    for at, line in enumerate(lines_of(text)):
        if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
            yield at, xxhash.xxh3_128_intdigest(key.encode())


_LOW = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _counted(piece: pa.RecordBatch, texts: list, min_chars: int) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts):
        for h in {h for _, h in _keys(text, min_chars)}:
            entry = found.setdefault(h, [0, doc_id])
            entry[0] += 1
            if entry[1] is None or (doc_id is not None and doc_id > entry[1]):
                entry[1] = doc_id
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([_signed(h >> 64) for h in found], pa.int64()),
            pa.array([_signed(h & _LOW) for h in found], pa.int64()),
            pa.array([c for c, _ in found.values()], pa.int64()),
            pa.array([k for _, k in found.values()], pa.int64()),
        ],
        names=["high", "low", "n_docs", "keeper"],
    )


def _placed(piece: pa.RecordBatch, texts: list, min_chars: int) -> Iterator[pa.RecordBatch]:
    rows = [(row, at, h) for row, text in enumerate(texts) for at, h in _keys(text, min_chars)]
    owner = pa.array([r for r, _, _ in rows], pa.int64())
    yield pa.RecordBatch.from_arrays(
        [
            piece.column("doc_id").take(owner),
            piece.column("text_hash").take(owner),
            pa.array([a for _, a, _ in rows], pa.int32()),
            pa.array([_signed(h >> 64) for _, _, h in rows], pa.int64()),
            pa.array([_signed(h & _LOW) for _, _, h in rows], pa.int64()),
        ],
        names=["doc_id", "text_hash", "at", "high", "low"],
    )


def counted_lines(docs: DataFrame, min_chars: int = 40) -> DataFrame:
    """``high, low`` (line hash), ``n_docs`` and ``keeper`` of every distinct long line."""
    schema = "high long, low long, n_docs long, keeper long"
    rows = docs.select("doc_id", "text").mapInArrow(_lines(min_chars, _counted), schema)
    return rows.groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


NO_ID = -(2**63)


def _shards(lines: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: its perfect hash, and the arrays in the order of its places."""

    def build(key, pdf):
        low = pdf["low"].to_numpy()
        hashed = PerfectHash.over(low.view(np.uint64))
        place = hashed.places(low.view(np.uint64))
        sizes, bits = hashed.packed()
        arrays = {name: np.empty(len(np.unique(low)), np.int64) for name in ("low", "high", "n_docs", "keeper")}
        for name, values in arrays.items():
            values[place] = pdf[name].to_numpy()
        return pd.DataFrame({"shard": [key[0]], "sizes": [sizes], "bits": [bits], **{name: [v.tobytes()] for name, v in arrays.items()}})

    known = lines.withColumns({"shard": _shard("low", n_shards), "keeper": F.coalesce("keeper", F.lit(NO_ID))})
    return known.groupBy("shard").applyInPandas(
        build, "shard int, sizes binary, bits binary, low binary, high binary, n_docs binary, keeper binary"
    )


def _shard(column: str, n_shards: int):
    return F.pmod(F.col(column), F.lit(n_shards)).cast("int")


INDEX = ["sizes", "bits", "lows", "highs", "keepers"]
PLACES = "doc_id long, text_hash long, at int"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, salt), the shard's own row first; give the places to drop."""
    current, index = None, None
    for batch in batches:
        shard, salt = batch.column("shard").to_numpy(), batch.column("salt").to_numpy()
        edges = [0, *(np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if (shard[a], salt[a]) != current:
                current, index = (shard[a], salt[a]), None
            if not part.column("is_line")[0].as_py():
                sizes, bits, *arrays = (part.column(n)[0].as_py() for n in INDEX)
                index = PerfectHash.unpacked(sizes, bits), [np.frombuffer(x, np.int64) for x in arrays]
                part = part.slice(1)
            if index is None or part.num_rows == 0:
                continue
            hashed, (lows, highs, keepers) = index
            low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
            at = hashed.places(low.view(np.uint64))
            known = at >= 0
            at[~known] = 0
            ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
            drop = pa.array(np.flatnonzero(known & (lows[at] == low) & (highs[at] == high) & (keepers[at] != ids)))
            yield part.select(["doc_id", "text_hash", "at"]).take(drop)


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text_hash, at``: each line that goes, by its place in the text."""
    shared = checkpointed(counted_lines(docs, min_chars).where(F.col("n_docs") >= min_docs))
    n_shards = max(MIN_SHARDS, -(-shared.count() // SHARD_KEYS))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    number = {n: F.lit(0).cast(kind).alias(n) for n, kind in (("doc_id", "long"), ("text_hash", "long"), ("at", "int"), ("high", "long"), ("low", "long"))}
    index = _shards(shared, n_shards).select(
        "shard", salts, F.lit(False).alias("is_line"), *number.values(),
        "sizes", "bits", F.col("low").alias("lows"), F.col("high").alias("highs"), F.col("keeper").alias("keepers"),
    )
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _lines(min_chars, _placed), "doc_id long, text_hash long, at int, high long, low long"
    )
    lines = rows.select(
        _shard("low", n_shards).alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
        F.lit(True).alias("is_line"), *number, *(F.lit(None).cast("binary").alias(n) for n in INDEX),
    )
    together = index.unionByName(lines).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_line")
    return together.mapInArrow(_probe, PLACES)


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch, "text"):
            n_lines, kept = [], []
            for text, places in zip(texts, piece.column("places").to_pylist()):
                lines = lines_of(text)
                n_lines.append(len(lines))
                gone = set(places or ())
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text or "")
            n_dropped = [len(set(p or ())) for p in piece.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "text"],
            )


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: every document with its remaining lines."""
    gone = (
        dropped_lines(docs, min_chars, min_docs)
        .groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
        .agg(F.collect_set("at").alias("places"))
    )
    joined = docs.select("doc_id", "text").join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.xxhash64("text") == F.col("gone_hash")), "left"
    )
    return joined.select("doc_id", "text", "places").mapInArrow(_rebuilt, "doc_id long, n_lines long, n_dropped long, text string")


def line_digests(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """As ``drop_shared_lines``, with the SHA-256 of the remaining text in its place."""
    kept = drop_shared_lines(docs, min_chars, min_docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
