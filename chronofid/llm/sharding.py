"""Deal documents to shards on a consistent-hash ring with virtual nodes and bounded loads.

Method. Every shard has ``VIRTUAL_NODES`` points on a ring of hash values; a document lies on the arc that ends
at the next point clockwise and belongs to that point's shard. No shard takes more rows than its bound, which
is the mean rounded down or up, so counts are at most one apart. The rows of an arc that its shard has no room
for (those farthest along the arc) go on clockwise to the next point whose shard has room.

How it runs. One aggregation counts the rows per arc: as many numbers as there are points, whatever the input.
From them the driver works out the cuts: which stretch of each arc goes to which shard, and at which slot the
stretch begins. Rows are then numbered inside their arc in ring order and look up their stretch, so
no row passes through the driver and rows that nothing pushes along stay where the plain ring puts them.

Defined cases. A null text has size 16 and the checksum of the empty text. Rows without a ``doc_id`` lie where
the empty text lies. Repeated rows are dealt one by one; equal rows are interchangeable. An empty table gives an
empty result. Columns beyond ``doc_id`` and ``text`` are not read, only carried. Rows that repeat one ``doc_id`` are numbered by one task,
which sorts them on disk if need be; the column is an id, so they are few.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VIRTUAL_NODES = 64
#: Places on the ring: 15 hexadecimal digits of an MD5.
DIGITS = 15


def place(text: Column) -> Column:
    """Where on the ring a text lies."""
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """``(place, shard)`` of all points in ring order; a bounded list of ``shards * nodes`` entries."""
    points = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("node"))
    placed = points.select(place(F.concat(F.lit("shard "), "shard", F.lit(" node "), "node")).alias("place"), "shard")
    return sorted((row.place, row.shard) for row in placed.collect())


def bounds(rows: int, shards: int) -> list[int]:
    """Rows that each shard may take: the mean, rounded up for the first few."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def cuts(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first, last, shard, slot)``: rows ``first`` to ``last`` of an arc go to ``shard`` from ``slot`` on.

    Every shard first takes from its own arcs in ring order; what is left walks clockwise, the rows that have
    walked longest first, until a shard with room takes it.
    """
    room, used, out, waiting = list(room), [0] * len(room), [], []

    def take(arc: int, first: int, amount: int, shard: int) -> int:
        n = min(amount, room[shard])
        if n:
            out.append((arc, first, first + n - 1, shard, used[shard]))
            room[shard] -= n
            used[shard] += n
        return n

    over = [0] * len(points)
    for arc, (_, shard) in enumerate(points):
        over[arc] = counts.get(arc, 0) - take(arc, 0, counts.get(arc, 0), shard)
    for turn in range(2):
        for arc, (_, shard) in enumerate(points):
            while waiting and room[shard]:
                owner, first, amount = waiting.pop(0)
                n = take(owner, first, amount, shard)
                if n < amount:
                    waiting.insert(0, (owner, first + n, amount - n))
            if turn == 0 and over[arc]:
                waiting.append((arc, counts[arc] - over[arc], over[arc]))
    return out


#: The ring is also cut into equal buckets, so that a position finds its arc by an equality join.
BUCKETS = 4096
RING = 16**DIGITS


def arc_table(spark: SparkSession, points: list[tuple[int, int]]) -> DataFrame:
    """``bucket, low, high, arc``: the arcs (``low`` < position <= ``high``) that each bucket meets.

    At most one row per bucket and one per point.
    """
    width, rows, last = RING // BUCKETS, [], -1
    for arc, (high, _) in enumerate(points):
        rows += [(b, last, high, arc) for b in range(max(0, (last + 1) // width), high // width + 1) if last < high]
        last = max(last, high)
    rows += [(b, last, RING, 0) for b in range((last + 1) // width, BUCKETS)]
    return spark.createDataFrame(rows, "bucket long, low long, high long, arc int")


def located(docs: DataFrame, points: list[tuple[int, int]], carry: bool) -> DataFrame:
    """``doc_id, size, text_crc32, position, arc`` of every row, and with ``carry`` the whole ``row``."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        place(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("position"),
        *([F.struct("*").alias("row")] if carry else []),
    )
    arcs = F.broadcast(arc_table(docs.sparkSession, points))
    inside = (F.floor(F.col("position") / (RING // BUCKETS)) == F.col("bucket")) & (F.col("position") > F.col("low")) & (F.col("position") <= F.col("high"))
    return rows.join(arcs, inside).select(*rows.columns, "arc")


def _dealt(docs: DataFrame, shards: int, nodes: int, carry: bool) -> DataFrame:
    spark = docs.sparkSession
    points = ring(spark, shards, nodes)
    counts = {r.arc: r.n for r in located(docs, points, False).groupBy("arc").agg(F.count("*").alias("n")).collect()}
    stretches = cuts(points, counts, bounds(sum(counts.values()), shards))
    stretched = spark.createDataFrame(stretches, "of int, first long, last long, shard int, slot long")
    order = Window.partitionBy("arc").orderBy("position", "doc_id", "text_crc32", "size")
    numbered = located(docs, points, carry).withColumn("at", F.row_number().over(order) - 1)
    found = numbered.join(F.broadcast(stretched), (F.col("arc") == F.col("of")) & F.col("at").between(F.col("first"), F.col("last")))
    return found.withColumn("slot", F.col("slot") + F.col("at") - F.col("first"))


def shard_slots(docs: DataFrame, shards: int = 40, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots of a shard run from 0 without a gap."""
    return _dealt(docs, shards, nodes, False).select("doc_id", "size", "text_crc32", "shard", "slot")


def sharded(docs: DataFrame, shards: int = 40, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """All columns of every row, with ``shard`` and ``slot`` (which replace columns of these names)."""
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return _dealt(docs, shards, nodes, True).select(*kept, "shard", "slot")


def nearest(points: list[tuple[int, int]], position: int) -> int:
    """The arc of one position: its end is the first point at or after it, or the first of all."""
    return bisect_left([p for p, _ in points], position) % len(points)
