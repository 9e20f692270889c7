"""Merkle manifest of a document table: digests per row, per group and for the whole, and a proof for every row.

Method. A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Leaves of a
group (``lang``) are numbered by ``doc_id``; on every level each run of eight neighbours becomes one parent, the digest of their
hex digests in order, until one node is left. Siblings come from lag and lead columns with fixed offsets 1 to 7, masked by a
node's slot in its run and the run's length; first children hash the parents. The groups' last nodes, ordered by group, are the
leaves of one more tree with the same rule. Paths are handed down level by level, so a row gets its siblings up to the root.

Scale. Texts are hashed in the scan and never shuffled. Positions come from a range partitioning of the leaves: a row's place in
its partition plus the number of its group's rows in partitions before, so a group of any size is numbered without a task that
holds it. Windows run over blocks of ``BLOCK`` positions, which hold whole runs. A level has an eighth of the rows below it and is
written to the checkpoint folder; only the number of levels is known to the driver. Paths travel once per run of leaves.

Defined cases. Null ``lang`` is a group of its own, before all others; null ``doc_id`` goes first in its group; rows with one ``doc_id``
are ordered by leaf. Repeated rows are leaves of their own. Null and empty texts differ. A single row is its own subroot and
root, with a proof of no siblings. An empty table gives an empty result. Columns beyond the five fields are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofid.session import checkpointed

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, and positions that one window covers (whole runs of runs).
WIDTH = 8
BLOCK = WIDTH**3

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Digest of the five fields of a row, with some of them replaced."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in FIELDS)), 256)


def group_name(value: Column) -> Column:
    """A string that sorts as the value does, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0 within ``grp`` by ``order``) and ``n`` (rows of the group) without bringing a group to one task."""
    # Equal rows get numbers too, so that a row repeated many times can be cut between partitions.
    rows = checkpointed(rows.withColumn("nth", F.monotonically_increasing_id()))
    by = ["grp", *order, "nth"]
    placed = checkpointed(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).drop("nth"))
    part = F.shiftright("at", 33)
    counts = placed.groupBy("grp", part.alias("part")).agg(F.count("*").alias("c"), F.min("at").alias("first"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "grp", "part", (F.coalesce(F.sum("c").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("grp")).alias("n")
    )
    joined = placed.withColumn("part", part).join(offsets, ["grp", "part"])
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add ``slot``, and as ``left`` and ``right`` the digests of the other nodes of the run before and after a node."""
    # One SQL text for each side: built column by column, a level would cost the driver more than its job.
    inside = f"OVER (PARTITION BY grp, pos div {BLOCK} ORDER BY pos)"
    slot, length = f"pos % {WIDTH}", f"least({WIDTH}, n - pos + pos % {WIDTH})"
    before = [f"if({slot} >= {k}, lag(node, {k}) {inside}, '')" for k in range(WIDTH - 1, 0, -1)]
    after = [f"if({slot} + {k} < {length}, lead(node, {k}) {inside}, '')" for k in range(1, WIDTH)]
    return nodes.withColumns({"slot": F.expr(slot), "left": F.expr(f"concat({', '.join(before)})"), "right": F.expr(f"concat({', '.join(after)})")})


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Levels of the trees of all groups, from the leaves (``grp, pos, n, node``) up; a group ends at the level where it has one node."""
    levels = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = with_siblings(levels[-1].where("n > 1")).where("slot = 0")
        parents = first.select(
            "grp", F.expr(f"pos div {WIDTH}").alias("pos"), F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), F.sha2(F.concat("node", "right"), 256).alias("node")
        )
        levels.append(checkpointed(parents))
        most = -(-most // WIDTH)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """``grp, node``: the last node of each group."""
    ends = [level.where("n = 1").select("grp", "node") for level in levels]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def descended(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves with ``path``: an array of the siblings ``(left, right)`` on every level, then ``above`` (``grp, path``) of the group."""
    out = None
    for depth in reversed(range(len(levels))):
        kept = levels[depth].columns if depth == 0 else ["grp", "pos"]
        at_top = levels[depth].where("n = 1").join(above, "grp").select(*kept, "path")
        if out is None:
            out = at_top
            continue
        parents = out.select("grp", F.col("pos").alias("parent"), F.col("path").alias("further"))
        below = with_siblings(levels[depth].where("n > 1")).withColumn("parent", F.expr(f"pos div {WIDTH}")).join(parents, ["grp", "parent"])
        path = F.concat(F.array(F.struct("left", "right")), "further")
        out = at_top.unionByName(below.select(*kept, path.alias("path")))
    return out


def siblings_digest(path: Column) -> Column:
    """Digest of all siblings of a path, in its order."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def folded(path: Column, leaf: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Where ``tampered`` holds, the root is folded from a leaf with ``tampered_text`` in place of ``text``, along the siblings of the
    untampered tree; ``verified`` tells whether it is the root. By default nothing is tampered with.
    """
    leaf = leaf_digest()
    shown = leaf if tampered is None else F.when(tampered, leaf_digest(text=tampered_text)).otherwise(leaf)
    rows = docs.select("doc_id", group_name(F.col("lang")).alias("grp"), leaf.alias("node"), shown.alias("shown"))
    leaves = checkpointed(numbered(rows, ["doc_id", "node"]))
    levels = grown(leaves)
    subroots = tops(levels).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node")
    groups = grown(checkpointed(numbered(subroots, ["name"])))
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    whole = checkpointed(tops(groups).select("grp", nothing.alias("path"), F.col("node").alias("root")))
    of_group = descended(groups, whole.drop("root")).join(whole.select("grp", "root"), "grp")
    of_group = checkpointed(of_group.select(F.col("name").alias("grp"), F.col("node").alias("subroot"), "root", "path"))
    # Subroot and root ride on the top of the path, so that no hot group meets its one row in a join of leaves.
    crowned = of_group.select("grp", F.concat("path", F.array(F.struct(F.col("subroot").alias("left"), F.col("root").alias("right")))).alias("path"))
    full = descended(levels, crowned)
    path, crown = F.slice("path", 1, F.size("path") - 1), F.element_at("path", -1)
    out = full.select("doc_id", F.col("node").alias("leaf"), crown["left"].alias("subroot"), crown["right"].alias("root"), "shown", path.alias("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.col("shown")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered_where_three_divides(docs: DataFrame) -> DataFrame:
    """``manifest`` of the documents, tampered with where 3 divides the CRC-32 of the decimal ``doc_id``: A-Z of the text in lower case."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER))
