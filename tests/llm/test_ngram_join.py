import random

import numpy as np
import pytest

from chronofid.llm import graph, ngram_join

from .conftest import sentence


def brute(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {(d, len(s), root(d)) for d, s in sets}


def family(draw, base, copies, changes):
    out = []
    for _ in range(copies):
        words = base.split()
        for at in draw.sample(range(len(words)), changes):
            words[at] = sentence(draw, 1)
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def families():
    draw = random.Random(9)
    texts = [sentence(draw, 90, "abcdefghijklmnop") for _ in range(30)]
    passage = sentence(draw, 30, "abcdefghijklmnop")
    texts += [t + " " + passage for t in texts[:15]]
    texts += family(draw, texts[0], 25, 1) + family(draw, texts[1], 25, 2) + family(draw, texts[2], 10, 3)
    chain = sentence(draw, 120, "abcdefghijklmnop").split()
    texts += [" ".join(chain[k * 3 : 90 + k * 3]) for k in range(10)]
    long_ = sentence(draw, 2500, "abcdefghijklmnop")
    texts += [long_, *family(draw, long_, 3, 20), *family(draw, long_, 3, 200), sentence(draw, 2600)]
    texts += texts[:3] * 2 + ["Same WORDS", "same words", "a", "a b", "", "   "]
    return list(enumerate(texts))


@pytest.mark.parametrize("width, percent, block", [(3, 90, 1024), (5, 80, 1024), (3, 90, 6), (5, 80, 6)])
def test_equals_comparison_of_all_pairs(spark, families, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "LANDMARKS", 2)
    got = ngram_join.near_duplicates(spark.createDataFrame(families, "doc_id long, text string"), width, percent).collect()
    assert {tuple(r) for r in got} == brute(families, width, percent)


def test_messy_and_empty(messy, messy_rows, nothing):
    got = ngram_join.near_duplicates(messy, 3, 90).collect()
    assert len(got) == len(messy_rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {tuple(r) for r in got if r.doc_id is not None} == brute([r[:2] for r in messy_rows if r[0] is not None], 3, 90)
    assert ngram_join.near_duplicates(nothing[0]).count() == 0


def test_linking_sets_share_a_band_and_a_prefix():
    for percent in (80, 90):
        edges = ngram_join.band_edges(percent)
        for n in range(1, 2000):
            partner = 100 * n // percent
            assert np.searchsorted(edges, partner, "right") - np.searchsorted(edges, n, "right") <= 1
            overlap = -(-percent * n // 100)
            assert n - ngram_join.prefix_length(n, percent) < overlap


def test_bitmaps_never_understate_the_overlap():
    draw = np.random.default_rng(1)
    for n in (3, 40, 700, 3000):
        x = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], draw.integers(0, 1 << 62, n).astype(np.uint64)]))
        for bits in (256, 1024, 2048):
            apart = int(np.bitwise_count(ngram_join.parity(x, bits) ^ ngram_join.parity(y, bits)).sum())
            assert (len(x) + len(y) - apart) // 2 >= len(np.intersect1d(x, y))
        assert (ngram_join.folded(ngram_join.parity(x, 1024), 256) == ngram_join.parity(x, 256)).all()


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60) if i != 30] + [(100, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 31)) and all(got[i] == 31 for i in range(32, 61)) and got[100] == 0
