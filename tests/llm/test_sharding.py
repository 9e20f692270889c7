import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from chronofid.llm import sharding


def brute(points, positions, shards):
    """Row by row: first every shard's own rows in ring order, then what is left walks clockwise."""
    room = sharding.bounds(len(positions), shards)
    arcs = {}
    for p in sorted(positions):
        arcs.setdefault(sharding.nearest(points, p), []).append(p)
    # Positions beyond the last point belong to the first arc and come last there.
    order = {a: sorted(x) for a, x in arcs.items()}
    out, left = [], {}
    for arc, (_, shard) in enumerate(points):
        for p in order.get(arc, []):
            if room[shard]:
                room[shard] -= 1
                out.append((p, shard))
            else:
                left.setdefault(arc, []).append(p)
    waiting = []
    for turn in range(2):
        for arc, (_, shard) in enumerate(points):
            while waiting and room[shard]:
                out.append((waiting.pop(0), shard))
                room[shard] -= 1
            if turn == 0:
                waiting += left.get(arc, [])
    assert not waiting
    return sorted(out)


def rows(spark, n, seed=1):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, "x" * draw.randint(0, 30) + "é") for i in range(n)], "doc_id long, text string")


def test_equals_row_by_row(spark):
    for n, shards in ((0, 5), (3, 7), (500, 7), (1000, 40)):
        docs = rows(spark, n)
        points = sharding.ring(spark, shards, 8)
        got = sharding.shard_slots(docs, shards, 8).join(docs.select("doc_id", sharding.place(F.col("doc_id").cast("string")).alias("p")), "doc_id").collect()
        assert sorted((r.p, r.shard) for r in got) == brute(points, [r.p for r in got], shards)
        counts = Counter(r.shard for r in got)
        assert len(got) == n and (n == 0 or max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_one_more_shard_moves_few_rows(spark):
    docs = rows(spark, 4000)
    a, b = ({r.doc_id: r.shard for r in sharding.shard_slots(docs, s).collect()} for s in (20, 21))
    moved = sum(a[i] != b[i] for i in a) / len(a)
    assert moved < 0.5  # dealing afresh would move 95 of 100


def test_sizes_and_checksums(spark, messy, messy_rows, nothing):
    got = sharding.shard_slots(messy, 4).collect()
    want = sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t, *_ in messy_rows)
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == want
    whole = sharding.sharded(messy, 4)
    assert set(whole.columns) == set(messy.columns) and dict(whole.dtypes)["shard"] == "int" and whole.count() == len(messy_rows)
    assert sharding.sharded(nothing[0], 4).count() == 0


def test_ties_on_the_ring(spark):
    docs = spark.createDataFrame([(1, "a")] * 30 + [(2, "b")] * 3, "doc_id long, text string")
    counts = Counter(r.shard for r in sharding.shard_slots(docs, 4).collect())
    assert sorted(counts.values()) == [8, 8, 8, 9]
