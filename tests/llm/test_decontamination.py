import random
import time

import pytest
from pyspark.sql import functions as F

from chronofid.llm import decontamination as D

from .conftest import sentence


def bag(words):
    out = {}
    for i in range(max(1, len(words) - D.WIDTH + 1)):
        g = tuple(words[i : i + D.WIDTH])
        out[g] = out.get(g, 0) + 1
    return out


def similarity(a, b):
    x, y = bag(a), bag(b)
    both = sum(min(n, y.get(g, 0)) for g, n in x.items())
    return both / (sum(x.values()) + sum(y.values()) - both)


def brute(docs, items):
    """Every window of every item's length in every document."""
    fold = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    out = {}
    for doc_id, text in docs:
        words = fold(text)
        for item_id, item in items:
            own = fold(item)
            if own and words:
                best = max(similarity(words[s : s + len(own)], own) for s in range(max(1, len(words) - len(own) + 1)))
                if best >= 0.8:
                    out[doc_id, item_id] = best
    return out


@pytest.fixture(scope="module")
def planted(spark):
    draw = random.Random(12)
    items = [(i, sentence(draw, n, "abcdefghijklm").capitalize() + ".") for i, n in enumerate([12, 25, 25, 40, 60, 60, 70])]
    items += [(20, "Four words only here"), (21, ""), (22, None), (23, items[1][1])]
    docs = []
    for i, (_, text) in enumerate(items[:7]):
        words = text.split()
        around = lambda x: sentence(draw, 50) + " " + " ".join(x) + "\n" + sentence(draw, 40)
        docs += [(10 * i, around(words)), (10 * i + 1, around([w.upper() + "," for w in words])), (10 * i + 2, " ".join(words)), (10 * i + 3, around(["zz", *words[1:]])), (10 * i + 4, around(words[: len(words) // 2]))]
        docs += [(10 * i + 5, around(words[:30] + ["zz"] + words[31:])), (10 * i + 6, " ".join(words[1:])), (10 * i + 7, around(words + words))]
    docs += [(200, "text with four words only here inside"), (201, None), (202, ""), (203, "..."), (204, sentence(draw, 300)), (0, docs[0][1])]
    return docs, items


def test_equals_all_windows(spark, planted):
    docs, items = planted
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(want) > 30
    assert all(abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-9 for r in got)


def test_edits_that_shift_both_sides_of_the_best_window(spark):
    draw = random.Random(31)
    items, docs = [], []
    for i, (n, gone, more) in enumerate([(59, 1, 2), (200, 8, 16), (90, 2, 4)]):
        words = [f"w{i}x{k}" for k in range(n)]
        items.append((i, " ".join(words)))
        left = words[gone : n - gone]
        left = left[: len(left) // 2] + [f"new{i}x{k}" for k in range(more)] + left[len(left) // 2 :]
        docs.append((i, " ".join([sentence(draw, 80), *left, sentence(draw, 80)])))
    got = {(r.doc_id, r.item_id): r for r in D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) == {(0, 0), (1, 1), (2, 2)}
    assert all(abs(got[k].similarity - want[k]) < 1e-9 for k in want) and got[0, 0].start == 80


def test_slices_change_nothing(spark, planted, monkeypatch):
    docs, items = (spark.createDataFrame(x, f"{n} long, text string") for x, n in zip(planted, ("doc_id", "item_id")))
    whole = {tuple(r) for r in D.leaks(docs, items).collect()}
    monkeypatch.setattr(D, "SLICE", 70)
    assert {tuple(r) for r in D.leaks(docs, items).collect()} == whole


def test_blocks_find_every_fingerprint_in_the_radius():
    draw = random.Random(3)
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), D.RADIUS):
            b ^= 1 << bit
        keys = [((a >> k * D.BLOCK_BITS) & 255, (b >> k * D.BLOCK_BITS) & 255) for k in range(D.BLOCKS)]
        assert any(bin(x ^ y).count("1") <= D.TURNS for x, y in keys)


def test_items_of_any_length(spark):
    """Long items, repeating ones, and edits at one end that bring the similarity close to the limit."""
    draw, items, docs, spent = random.Random(8), [], [], []
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    for i, n in enumerate([50, 400, 4000]):
        words = [f"w{i}x{k}" for k in range(n)]
        loop = [f"l{i}x{k % 10}" for k in range(n)]
        items += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(loop))]
        end = n // 12
        texts = [words, words[:end] + ["new"] + words[end + 1 :], words[: n - end] + [f"e{k}" for k in range(end)], words[: n // 2], loop + loop[:25], loop[: n // 2]]
        docs += [(100 * i + k, " ".join([sentence(draw, 30), *t, sentence(draw, 30)])) for k, t in enumerate(texts)]
        started = time.monotonic()
        assert D.leaks(frame(docs[-6:], "doc_id"), frame(items[-2:], "item_id")).count() == 4
        spent.append(time.monotonic() - started)
    # Eighty times the words; the work of a session's first run is in the shortest.
    assert spent[2] < 8 * spent[0]
    got = {(r.doc_id, r.item_id): r for r in D.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    want = brute([d for d in docs if d[0] < 200], [t for t in items if t[0] < 20])
    assert {k for k in got if k[0] < 200} == set(want) and all(abs(got[k].similarity - want[k]) < 1e-9 for k in want)
    assert {k for k in got if k[0] >= 200} == {(200 + k, 20) for k in range(3)} | {(204, 21)}


def test_all_edits_near_the_limit_are_in_the_radius(spark):
    """Items with 40 to 800 different words, a twentieth replaced at one end: similarity 0.8 to 0.91, none lost."""
    items, docs = [], []
    for i in range(160):
        n = [40, 120, 300, 800][i % 4]
        words = [f"v{i}y{k}" for k in range(n)]
        gone = int((n - 4) / 9.2)
        items.append((i, " ".join(words)))
        docs.append((i, " ".join([f"z{i}y{k}" for k in range(gone)] + words[gone:])))
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = D.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(160)} and max(r.hamming for r in got) <= D.RADIUS


def test_decontaminate_keeps_the_rest_with_all_columns(spark, messy, messy_rows, nothing):
    items = spark.createDataFrame([(1, messy_rows[0][1]), (2, None)], "item_id long, text string").withColumn("doc_id", F.lit(3))
    got = D.decontaminate(messy, items)
    assert got.columns == messy.columns
    held = {i for i, t, *_ in messy_rows if t and messy_rows[0][1] in t}
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r[0]) for r in messy_rows if r[0] not in held)
    assert D.decontaminate(nothing[0], items).count() == 0
    assert D.decontaminate(messy, items.where(F.lit(False))).count() == len(messy_rows)
