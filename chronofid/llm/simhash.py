"""Near-duplicate documents by the distance of their SimHash fingerprints.

Method. A text's fingerprint has a bit set where more than half of the XXH64 hashes (seed 42) of its word shingles, repeats included,
have it. Fingerprints link at ``RADIUS`` = 4 or fewer differing bits. Four bits change four of the eight bytes at most, so two that
link agree in at least ``SHARED`` = 4 bytes at their positions.

* Index. Any four of eight positions hold three of the first seven. The inverted index therefore posts a fingerprint under the
  values of each three of its first seven bytes (35 postings) rather than under single bytes, whose lists would hold 1/256 of all rows.
* Count filter. Inside a list, the bytes that a pair shares by position are tallied; pairs below ``SHARED`` are gone.
* Verification. The differing bits of the others are counted. Links become connected components.

Scale. Equal fingerprints are one from the start, so copies cost one posting list entry. A list is 24 bits wide; lists above
``LIST`` fingerprints are cut in blocks of which any two meet in one unit, so no task gets a whole hot list. Inside a large unit
links are followed breadth first and only a spanning tree is put out; a pair in a small one is put out in the first list that the
two share. No list of all pairs is ever made, nothing is cut off, and nothing is collected or broadcast.

Defined cases. Null, empty and blank texts have fingerprint zero, which links like any other; with fewer words than a shingle the whole
sequence is the one shingle. Very long texts are hashed piece by piece. Repeated rows link. Rows without ``doc_id`` get a
fingerprint and a null component, and link nothing. An empty table gives an empty result. Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.llm.graph import components
from chronofid.llm.ngram_join import _whole_units
from chronofid.llm.text import chunks
from chronofid.session import checkpointed

SEED, RADIUS, SHARED = 42, 4, 4
#: Positions of the bytes in a posting, in the order that tells which list of a pair is its first.
POSTINGS = list(combinations(range(7), 3))
#: Fingerprints of a list that meet in one unit; above, the list is cut in blocks of so many.
LIST = 16_384
#: Up to so many fingerprints of a unit, neighbours are compared step by step for all units at once.
SMALL = 64
#: Shingles hashed at a time, and bytes of a text split into words at a time.
STRETCH, PART = 1 << 18, 1 << 21

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def text_parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """Pieces of a text near ``size`` bytes, cut at white space."""
    start = 0
    while start < len(data):
        found = _SPACE.search(data, start + size)
        end = found.start() if found else len(data)
        yield data[start:end]
        start = end


def shingles(text: str | None, width: int) -> Iterator[list[bytes]]:
    """The word shingles of a text, repeats included, a list for each piece of it."""
    held: list[bytes] = []
    any_yet = False
    for part in text_parts((text or "").encode().lower()):
        held += part.split()
        if len(held) < width:
            continue
        line = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        yield [line[a:b] for a, b in zip(starts[: len(held) - width + 1].tolist(), ends[width - 1 :].tolist())]
        held, any_yet = held[len(held) - width + 1 :], True
    if held and not any_yet:
        yield [b" ".join(held)]


def _prints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, texts in chunks(batch, "text"):
            ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
            waiting: list[bytes] = []
            owner: list[tuple[int, int]] = []

            def settle() -> None:
                if not waiting:
                    return
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, waiting, repeat(SEED)), np.uint64, len(waiting))
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                rows, sizes = (np.array(x) for x in zip(*owner))
                # A text may come up twice in a row of pieces, so its sums are added.
                np.add.at(ones, rows, np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int64))
                np.add.at(total, rows, sizes)
                waiting.clear()
                owner.clear()

            for row, text in enumerate(texts):
                for some in shingles(text, width):
                    waiting += some
                    owner.append((row, len(some)))
                    if len(waiting) > STRETCH:
                        settle()
            settle()
            prints = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, print``: the fingerprint of every row as a signed 64-bit number."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(partial(_prints, width=width), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long")


def postings(prints: DataFrame) -> DataFrame:
    """``list, print``: a row for each three of the first seven bytes; the list's number starts with the number of the three."""
    byte = [f"(shiftrightunsigned(print, {8 * k}) & 255)" for k in range(8)]
    lists = [f"CAST({number << 24} + {byte[a]} * 65536 + {byte[b]} * 256 + {byte[c]} AS INT)" for number, (a, b, c) in enumerate(POSTINGS)]
    return prints.select("print", F.explode(F.expr(f"array({', '.join(lists)})")).alias("list"))


def same_bytes(differ: np.ndarray) -> np.ndarray:
    """For differing bits, a bit for each position whose bytes are equal."""
    return np.packbits(differ.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little").reshape(-1)


def linked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs link, and the positions of the bytes that each pair shares."""
    differ = x ^ y
    shared = same_bytes(differ)
    out = np.zeros(len(differ), bool)
    candidates = np.flatnonzero(np.bitwise_count(shared) >= SHARED)
    out[candidates] = np.bitwise_count(differ[candidates]) <= RADIUS
    return out, shared


def spanning(values: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what links in one unit: breadth first, each value found once."""
    left, found = np.arange(len(values)), []
    while len(left) > 1:
        waiting, left = [int(left[0])], left[1:]
        while waiting and len(left):
            here = waiting.pop()
            near = linked(values[left], values[here : here + 1])[0]
            hits = left[near].tolist()
            found += [(here, k) for k in hits]
            left = left[~near]
            waiting += hits
    return found


#: First list that a pair shares, by the positions it shares; -1 where it has no three of them.
FIRST_LIST = np.array([next((k for k, three in enumerate(POSTINGS) if all(shared >> p & 1 for p in three)), -1) for shared in range(128)], np.int64)


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in each unit, from rows sorted by unit."""
    for table in _whole_units(batches, 1 << 16):
        unit, number = table.column("unit").to_numpy(), table.column("list").to_numpy() >> 24
        value = table.column("print").to_numpy().astype(np.int64).view(np.uint64)
        begins, ends = np.searchsorted(unit, unit, "left"), np.searchsorted(unit, unit, "right")
        small = ends - begins <= SMALL
        u, v = [], []
        for step in range(1, int((ends - begins)[small].max(initial=0))):
            i = np.flatnonzero(small[:-step] & (unit[:-step] == unit[step:]))
            near, shared = linked(value[i], value[i + step])
            first = near & (FIRST_LIST[shared & 127] == number[i])
            u.append(value[i[first]])
            v.append(value[i[first] + step])
        for begin in np.unique(begins[~small]):
            here = value[begin : ends[begin]]
            pairs = np.array(spanning(here), np.int64).reshape(-1, 2)
            u.append(here[pairs[:, 0]])
            v.append(here[pairs[:, 1]])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """``u, v``: links that connect all distinct fingerprints (``print``) within ``RADIUS`` of each other."""
    lists = postings(prints)
    sizes = checkpointed(lists.groupBy("list").count().where(F.col("count") > LIST))
    if sizes.isEmpty():
        units = lists.withColumn("unit", F.col("list").cast("long"))
    else:
        blocks = F.ceil(F.col("count") / LIST).cast("int")
        cut = lists.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("print"), blocks).cast("int"))
        other = F.explode(F.filter(F.sequence(F.lit(0), blocks - 1), lambda k: k != F.col("block")))
        met = cut.withColumn("other", other).withColumn("unit", F.xxhash64("list", F.least("block", "other"), F.greatest("block", "other")))
        whole = lists.join(sizes, "list", "left_anti").withColumn("unit", F.col("list").cast("long"))
        units = whole.select("unit", "list", "print").unionByName(met.select("unit", "list", "print"))
    dealt = units.select("unit", "list", "print").repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInArrow(_examine, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits)``, component_id`` (smallest ``doc_id`` that links lead to) of every row."""
    prints = checkpointed(fingerprints(docs, width))
    known = checkpointed(prints.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("least")))
    tied = checkpointed(components(links(known.select("print"))))
    named = tied.select("node", "component").union(tied.select("component", "component").distinct())
    least = named.join(known, F.col("node") == F.col("print")).groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "component").select(F.col("node").alias("print"), "component_id")
    classes = known.join(of_print, "print", "left").select("print", F.coalesce("component_id", "least").alias("component_id"))
    # Written, so that the join below has two plain sides and the fingerprint of many copies can be split.
    out = prints.join(checkpointed(classes), "print", "left")
    digits = F.lpad(F.lower(F.hex("print")), 16, "0")
    return out.select("doc_id", digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
