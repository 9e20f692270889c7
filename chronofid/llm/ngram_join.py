"""Join near-duplicate documents by the Jaccard similarity of their word shingles.

Method. A document is the set of its distinct ``width``-word shingles (as 64-bit hashes). Equal sets are one
representative from the start. Two sets link when ``100 * intersection >= percent * union``.

* Tiles. In any fixed order of shingles two linking sets share one of their first ``n - ceil(percent * n / 100) + 1``
  shingles, and their sizes lie in the same or in neighbouring bands of ratio ``100 / percent``. So a set goes to
  one tile for each such shingle and band (``home``), and as a ``guest`` to the band above.
* Signatures. Each set has a bitmap of the parities of its hashed shingles. A bit that differs stands for at least one
  shingle that only one set has, so bit counts bound the overlap from above; pairs in a tile that the bound
  rules out are gone. What remains joins sets into clusters.
  Clusters are refined by the same bound with bitmaps as wide as the sets, which long texts need.
* Intersection. Inside a refined cluster, pairs not yet connected that the bound still allows have their
  sorted arrays intersected exactly. Only links that connect something new are put out.

Scale. The order puts shingles that are frequent in any stretch of the input last (the list of them comes from all
documents; it steers cost, never a result), so a passage that many documents share makes no large tile.
A tile or cluster above ``BLOCK`` sets is cut in blocks, which all meet the same few landmarks first; a family
of near copies becomes one component there, and only sets outside a group's largest component meet
all blocks afterwards. Different texts that are alike but do not link have to be compared one by one. Arrays are
made for clustered documents alone, from their texts.

Defined cases. Texts without words have an empty set and link with nothing. With fewer words than ``width`` the whole sequence is
the one shingle. Repeated rows and equal texts are one class. Different texts under one ``doc_id`` are not linked by it, but the id stands for
all of them in names and bodies: give them ids of their own first, as ``corpus_pipeline.named_texts`` does. Rows without ``doc_id`` are returned
with a null ``component_id`` and link nothing. An empty table gives an empty result. Columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.llm.graph import components
from chronofid.llm.text import chunks, lower_words, mixed, shingle_hashes, word_hashes
from chronofid.session import checkpointed

#: Bits of a signature, and of that of a set above LONG_SET shingles.
BITS, LONG_BITS, LONG_SET = 256, 1024, 1000
#: Words of bitmaps compared at a time.
PAIR_WORDS = 1 << 22
#: Weight of the sets compared in one unit at most (a unit of two blocks and landmarks holds some more than twice that);
#: a set whose array travels weighs one for every HEAVY shingles it has.
BLOCK, HEAVY = 4096, 1000
LANDMARKS = 32
#: A shingle is frequent if this share of the documents of a stretch of input has it, and at least so many.
FREQUENT_SHARE, FREQUENT_LEAST = 0.005, 16
#: Stretch of input for that, in shingles; entries of the list at most.
STRETCH, MAX_FREQUENT = 4_000_000, 100_000


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(word_hashes(lower_words(text)), width))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def band_edges(percent: int) -> np.ndarray:
    """First size of each band: sizes of linking sets differ by one band at most."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(100 * edges[-1] // percent + 1)
    return np.array(edges)


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of how often (odd or even) each of ``bits`` places is hit, as 64-bit words."""
    odd = np.bincount((mixed(hashes) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def wide_bits(n: int) -> int:
    """Width of the bitmap that a set of ``n`` shingles gets inside its cluster: a bit or two per shingle."""
    return 1 << max(10, int(n).bit_length())


def folded(signature: np.ndarray, bits: int) -> np.ndarray:
    """The narrower bitmap of the same set."""
    return np.bitwise_xor.reduce(signature.reshape(-1, bits // 64), axis=0)


def _frequent(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        known, times = np.unique(np.concatenate(sets), return_counts=True)
        keep = times >= max(FREQUENT_LEAST, FREQUENT_SHARE * len(sets))
        return pa.RecordBatch.from_arrays([pa.array(known[keep].view(np.int64)), pa.array(times[keep])], names=["h", "n"])

    sets, size = [], 0
    for batch in batches:
        for _, texts in chunks(batch, "text"):
            for text in texts:
                sets.append(shingle_set(text, width))
                size += len(sets[-1])
            if size > STRETCH:
                yield counted(sets)
                sets, size = [], 0
    if sets:
        yield counted(sets)


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that go last in the order; at most ``MAX_FREQUENT``."""
    rows = docs.select("text").mapInArrow(partial(_frequent, width=width), "h long, n long")
    most = rows.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(MAX_FREQUENT)
    return np.sort(most.select("h").toPandas()["h"].to_numpy().astype(np.int64).view(np.uint64))


def sets_of(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, digest, band, prefix, signature`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))
    edges = band_edges(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            for piece, texts in chunks(batch, "text"):
                rows = []
                for text in texts:
                    s = shingle_set(text, width)
                    if len(s):
                        frequent = np.isin(s, last, assume_unique=True) if len(last) else np.zeros(len(s), bool)
                        ordered = np.concatenate([s[~frequent], s[frequent]])
                        bits = LONG_BITS if len(s) > LONG_SET else BITS
                        rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), int(np.searchsorted(edges, len(s), "right")), ordered[: prefix_length(len(s), percent)].view(np.int64), parity(s, bits).tobytes()))
                    else:
                        rows.append((0, b"", 0, np.zeros(0, np.int64), b""))
                n, digest, band, prefix, signature = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.int32()), pa.array(prefix, pa.list_(pa.int64())), pa.array(signature, pa.binary())],
                    names=["doc_id", "n", "digest", "band", "prefix", "signature"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, band int, prefix array<long>, signature binary")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, band): the tiles where a set may meet another. A batch's ends are given the benefit of doubt."""
    for batch in batches:
        h, band, rep = (batch.column(c).to_numpy() for c in ("h", "band", "rep"))
        n = len(h)
        if n == 0:
            continue
        same = (h[1:] == h[:-1]) & (band[1:] == band[:-1])
        near = (h[1:] == h[:-1]) & (band[1:] == band[:-1] + 1)
        after, before = np.append(same, True), np.append(True, same | near)
        home = after | before
        # The first row of the next band tells whether a band has guests to send.
        last = np.flatnonzero(~np.append(same, False))
        run_end = last[np.searchsorted(last, np.arange(n))]
        guest = np.append(near, True)[run_end]
        rows = np.concatenate([np.flatnonzero(home), np.flatnonzero(guest)])
        up = np.concatenate([np.zeros(home.sum(), np.int32), np.ones(guest.sum(), np.int32)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[rows]), pa.array(band[rows] + up), pa.array(up == 0), pa.array(rep[rows])], names=["h", "tile_band", "home", "rep"]
        )


def _whole_units(batches: Iterator[pa.RecordBatch], least: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole units from batches that are sorted by unit."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        unit = table.column("unit").to_numpy()
        start = int(np.searchsorted(unit, unit[-1], "left"))
        if start:
            yield table.slice(0, start)
        held = table.slice(start).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _bitmaps(bodies: list[bytes], exact: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each width a matrix of bitmaps, and each set's row in it (-1 for sets whose own bitmap is narrower)."""
    words = [np.frombuffer(b, np.uint64) for b in bodies]
    if exact:
        words = [parity(w, wide_bits(len(w))) for w in words]
    bits = np.array([64 * len(w) for w in words])
    out = []
    for width in np.unique(bits):
        rows = np.flatnonzero(bits >= width)
        place = np.full(len(words), -1)
        place[rows] = np.arange(len(rows))
        out.append((np.array([folded(words[r], width) for r in rows]), place))
    return out


def _examine(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Links inside each unit that connect sets not connected yet; by bitmaps alone, or exactly."""
    for table in _whole_units(batches):
        unit, rep, n, comp = (table.column(c).to_numpy() for c in ("unit", "rep", "n", "comp"))
        home = np.asarray(table.column("home"))
        bodies = table.column("body").to_pylist()
        maps = _bitmaps(bodies, exact)
        begins = np.searchsorted(unit, unit, "left")
        ends = np.searchsorted(unit, unit, "right")
        # Sets of a unit that are connected have one label.
        label = np.array([0] * len(unit))
        for a in np.unique(begins):
            b = ends[a]
            label[a:b] = a + np.unique(comp[a:b], return_inverse=True)[1]
        found = []
        for step in range(1, int((ends - begins).max())):
            i = np.flatnonzero(unit[:-step] == unit[step:])
            if not len(i):
                break
            j = i + step
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (label[i] != label[j]) & (100 * small >= percent * large) & (home[i] | home[j])
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            apart = np.zeros(len(i), np.int64)
            for matrix, place in maps:
                use = np.flatnonzero((place[i] >= 0) & (place[j] >= 0))
                for part in np.array_split(use, 1 + len(use) * matrix.shape[1] // PAIR_WORDS):
                    differ = np.bitwise_count(matrix[place[i[part]]] ^ matrix[place[j[part]]]).sum(axis=1, dtype=np.int64)
                    apart[part] = np.maximum(apart[part], differ)
            overlap = (n[i] + n[j] - apart) // 2
            may = overlap * (100 + percent) >= percent * (n[i] + n[j])
            for a, b in zip(i[may].tolist(), j[may].tolist()):
                if label[a] == label[b]:
                    continue
                if exact:
                    x, y = np.frombuffer(bodies[a], np.uint64), np.frombuffer(bodies[b], np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both < percent * (len(x) + len(y) - both):
                        continue
                part = slice(begins[a], ends[a])
                label[part][label[part] == label[b]] = label[a]
                found.append((rep[a], rep[b]))
        u, v = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _links(units: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Run ``_examine`` over rows ``unit, rep, n, comp, home, body``."""
    dealt = units.select("unit", "rep", "n", "comp", "home", "body").repartition("unit").sortWithinPartitions("unit", "n", "rep")
    return dealt.mapInArrow(partial(_examine, percent=percent, exact=exact), "u long, v long").distinct()


def connected(members: DataFrame, bodies: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links that connect the members (``group, rep, home, weight``) of each group; ``bodies`` has ``rep, n, body`` of each rep."""
    sizes = members.groupBy("group").agg(F.sum("weight").alias("size")).where(F.col("size") > BLOCK)
    large = checkpointed(sizes)
    row = lambda frame, *unit: frame.join(bodies, "rep").withColumns({"unit": F.xxhash64("group", *unit), "comp": F.coalesce("comp", "rep")})
    alone = members.drop("weight").withColumn("comp", F.lit(None).cast("long"))
    if large.isEmpty():
        return _links(row(alone), percent, exact)
    # First every block by itself, with the landmarks of its group.
    small = alone.join(large, "group", "left_anti")
    cut = checkpointed(members.join(large, "group").withColumn("comp", F.lit(None).cast("long")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    landmark = F.pmod(F.xxhash64("rep", F.lit("landmark")), F.ceil(F.col("size") / LANDMARKS)) == 0
    everywhere = cut.where(landmark).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = cut.withColumn("block", block).unionByName(everywhere).dropDuplicates(["group", "block", "rep", "home"])
    first = checkpointed(_links(row(small.withColumn("block", F.lit(0)).unionByName(dealt.drop("size", "weight")), "block"), percent, exact))
    # Then what lies outside the largest component of its group, with all blocks.
    joined = cut.drop("comp").join(components(first), F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep"))
    joined = checkpointed(joined.select("group", "rep", "home", "comp", "weight"))
    counts = joined.groupBy("group", "comp").agg(F.sum("weight").alias("c"))
    core = counts.groupBy("group").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    known = joined.join(core.select("group", F.col("top.comp").alias("core"), F.col("top.c").alias("in_core"), (F.col("all") - F.col("top.c")).alias("rest")).where("rest > 0"), "group")
    core_blocks, rest_blocks = F.ceil(F.col("in_core") / BLOCK).cast("int"), F.ceil(F.col("rest") / BLOCK).cast("int")
    is_core = F.col("comp") == F.col("core")
    at = F.when(is_core, F.pmod(F.xxhash64("rep"), core_blocks)).otherwise(F.pmod(F.xxhash64("rep"), rest_blocks)).cast("int")
    placed = known.withColumn("at", at)
    name = lambda kind, a, b: F.concat_ws(" ", F.lit(kind), a, b)
    count = lambda n: F.sequence(F.lit(0), n - 1)
    with_rest = F.transform(count(rest_blocks), lambda k: F.when(is_core, name("core", k, F.col("at"))).otherwise(name("rest", F.least(k, F.col("at")), F.greatest(k, F.col("at")))))
    with_core = F.when(is_core, F.array().cast("array<string>")).otherwise(F.transform(count(core_blocks), lambda k: name("core", F.col("at"), k)))
    second = placed.withColumn("pair", F.explode(F.concat(with_rest, with_core)))
    return first.unionByName(_links(row(second.select("group", "rep", "home", "comp", "pair"), "pair"), percent, exact))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; the component is the smallest linked ``doc_id``."""
    sets = checkpointed(sets_of(docs, width, percent))
    full = sets.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # Copies are one representative: their smallest id. Equal sets agree in all other columns.
    reps = checkpointed(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "band", "prefix", "signature"))))
    entries = reps.select(F.explode("prefix").alias("h"), "band", "rep")
    tiles = entries.repartition("h").sortWithinPartitions("h", "band").mapInArrow(_tiles, "h long, tile_band int, home boolean, rep long")
    members = checkpointed(tiles.select(F.xxhash64("h", "tile_band").alias("group"), "rep", "home", F.lit(1).alias("weight")))
    near = connected(members, reps.select("rep", "n", F.col("signature").alias("body")), percent, exact=False)
    clusters = clusters_of(near, reps, 16 * HEAVY)
    near = connected(clusters, checkpointed(shingle_bodies(docs, clusters, width, arrays=False)), percent, exact=False)
    clusters = clusters_of(near, reps, HEAVY)
    links = connected(clusters, checkpointed(shingle_bodies(docs, clusters, width, arrays=True)), percent, exact=True)
    linked = components(links)
    of_rep = reps.select("rep", "digest").join(linked, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = sets.join(of_rep, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def clusters_of(near: DataFrame, reps: DataFrame, heavy: int) -> DataFrame:
    """``group, rep, home, weight`` of the sets that ``near`` connects."""
    found = components(near)
    named = found.select(F.col("component").alias("group"), F.col("node").alias("rep")).union(found.select("component", "component").distinct())
    weight = (1 + F.floor(F.col("n") / heavy)).alias("weight")
    return checkpointed(named.join(reps.select("rep", weight), "rep").withColumn("home", F.lit(True)))


#: Bits of the table that tells which documents to make bodies of, whatever their number: 8 MB.
FILTER_BITS = 1 << 26


def shingle_bodies(docs: DataFrame, reps: DataFrame, width: int, arrays: bool) -> DataFrame:
    """``rep, n, body`` (the sorted array, or a wide bitmap) of the documents that ``reps`` names, and of a few more, from their texts.

    A broadcast table of fixed size with a bit for the hash of each id saves a shuffle of the texts; whoever uses the
    bodies joins them by id.
    """
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    set_ = reps.groupBy(F.shiftright(bit, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(rep), {FILTER_BITS}) & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[set_.column("word").to_numpy()] = set_.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value.view(np.uint64)
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1))
            for piece, texts in chunks(batch, "text"):
                sets = [shingle_set(t, width) for t in texts]
                body = [(s if arrays else parity(s, wide_bits(len(s)))).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("rep"), pa.array(map(len, sets), pa.int64()), pa.array(body, pa.binary())],
                    names=["rep", "n", "body"],
                )

    rows = docs.select(F.col("doc_id").alias("rep"), "text").withColumn("bit", bit)
    return rows.mapInArrow(run, "rep long, n long, body binary").where("n > 0")
