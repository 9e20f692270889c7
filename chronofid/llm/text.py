"""Words, hashes and Arrow chunks shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

#: Text handled at a time inside one Arrow batch; word objects take some twenty times as much.
CHUNK_CHARS = 1 << 21

_FOLD = bytes(
    ord(chr(c).lower()) if c < 128 and chr(c).isalpha() else c if c >= 128 or chr(c).isdigit() or chr(c).isspace() else 32
    for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of ``text`` as UTF-8, as they stand."""
    return [] if text is None else text.encode().split()


def lower_words(text: str | None) -> list[bytes]:
    """``words`` with A-Z lower-cased; other letters stay."""
    return [] if text is None else text.encode().lower().split()


def folded_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and ASCII punctuation read as space."""
    return [] if text is None else text.encode().translate(_FOLD).split()


def word_hashes(listed: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))


def many_word_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts in one array, and where each text starts (one entry more)."""
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=starts[1:])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(lists)), np.uint64, int(starts[-1])), starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words in order; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out = mixed(out) + hashes[k : n - width + 1 + k]
    return mixed(out)


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut a batch so that the texts of a piece stay near ``CHUNK_CHARS``; a longer text is a piece of its own."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_CHARS, "right")))
        piece = batch.slice(start, stop - start)
        yield piece, piece.column(column).to_pylist()
        start = stop
