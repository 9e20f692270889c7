import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from chronofid.llm import merkle

from .conftest import sentence

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Last node, and for each leaf the list of (left, right) siblings."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            start = k - k % 8
            run = nodes[start : start + 8]
            paths[leaf].append(("".join(run[: k - start]), "".join(run[k - start + 1 :])))
            at[leaf] = k // 8
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = h(*map(field, (doc_id, source, lang, n_chars, text)))
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        shown = h(*map(field, (doc_id, source, lang, n_chars, lowered(text)))) if bad else leaf
        groups.setdefault(lang, []).append((doc_id is not None, doc_id, leaf, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    trees = [climb([r[2] for r in groups[name]]) for name in names]
    root, above = climb([t[0] for t in trees])
    out = []
    for name, (subroot, paths), further in zip(names, trees, above):
        for (_, doc_id, leaf, shown), path in zip(groups[name], paths):
            node = shown
            for left, right in path + further:
                node = h(left, node, right)
            out.append((doc_id, leaf, subroot, root, h(*(a + b for a, b in path + further)), node, node == root))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in merkle.lowered_where_three_divides(docs).collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [64, 65, 3], [600, 7, 1, 1, 1, 1, 1, 1, 1, 1]])
def test_equals_trees_built_by_hand(spark, sizes):
    draw = random.Random(len(sizes))
    rows = [(draw.randrange(10_000) * 1000 + g, "s", f"l{g}", k, sentence(draw, 3, "abCD")) for g, n in enumerate(sizes) for k in range(n)]
    draw.shuffle(rows)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_messy_and_empty(spark, messy, messy_rows, nothing):
    docs = messy.withColumn("n_chars", F.length("text").cast("long"))
    rows = [(d, s, lang, None if t is None else len(t), t) for d, t, lang, s in messy_rows]
    assert got(docs) == brute(rows)
    assert merkle.lowered_where_three_divides(nothing[0].withColumn("n_chars", F.lit(0))).count() == 0


def test_one_row_repeated_and_a_hot_group(spark):
    rows = [(7, None, "é", 1, "Same")] * 700 + [(k, "s", None, None, None) for k in range(70)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_windows_hold_whole_runs(spark):
    plan = merkle.with_siblings(spark.range(9).selectExpr("'g' AS grp", "id AS pos", "9L AS n", "'' AS node"))._jdf.queryExecution().toString()
    assert merkle.BLOCK % merkle.WIDTH == 0 and plan.count("Exchange hashpartitioning") <= 1
