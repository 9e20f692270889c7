import random

import numpy as np
import pytest
import xxhash

from chronofid.llm import simhash

from .conftest import sentence


def fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hashes) > len(hashes))


def brute(rows):
    prints = [(d, fingerprint(t)) for d, t in rows]
    parent = {d: d for d, _ in prints if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, p) for d, p in prints if d is not None]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if (x ^ y).bit_count() <= 4:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted(((d, f"{p:016x}", None if d is None else root(d)) for d, p in prints), key=str)


def got(docs):
    return sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)


@pytest.fixture(scope="module")
def families():
    draw = random.Random(5)
    texts = [sentence(draw, 400) for _ in range(12)]
    for base in texts[:4]:
        for _ in range(20):
            words = base.split()
            for at in draw.sample(range(len(words)), draw.choice([1, 2, 4])):
                words[at] = sentence(draw, 1)
            texts.append(" ".join(words))
    texts += [sentence(draw, n) for n in (1, 2, 3, 4, 5)] + [texts[0].upper(), texts[1].replace(" ", "\t\n")]
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("list_size, small", [(16_384, 64), (3, 2), (5, 64)])
def test_equals_comparison_of_all_pairs(spark, families, monkeypatch, list_size, small):
    monkeypatch.setattr(simhash, "LIST", list_size)
    monkeypatch.setattr(simhash, "SMALL", small)
    want = brute(families)
    assert got(spark.createDataFrame(families, "doc_id long, text string")) == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_messy_and_empty(messy, messy_rows, nothing):
    assert got(messy) == brute([r[:2] for r in messy_rows])
    assert simhash.near_duplicates(nothing[0]).count() == 0


def test_ids_of_other_types(spark):
    rows = [("b", "x y z w v"), ("a", "x y z w v"), ("c", None)]
    assert got(spark.createDataFrame(rows, "doc_id string, text string")) == brute(rows)


def test_fingerprints_at_every_distance(spark):
    """Chains of fingerprints whose neighbours are 4 or 5 bits apart, in any bytes."""
    draw = np.random.default_rng(3)
    for bits in (4, 5):
        value, chain = int(draw.integers(0, 1 << 62)), []
        for _ in range(40):
            chain.append(value)
            for k in draw.choice(64, bits, replace=False):
                value ^= 1 << int(k)
        signed = [x - (1 << 64) if x >> 63 else x for x in chain]
        pairs = {frozenset((x, y)) for i, x in enumerate(signed) for j, y in enumerate(signed[:i]) if (chain[i] ^ chain[j]).bit_count() <= 4}
        found = simhash.links(spark.createDataFrame([(x,) for x in signed], "print long")).collect()
        assert {frozenset((r.u, r.v)) for r in found} == pairs
        assert bits == 5 or len(pairs) >= 39


def test_pieces_of_a_long_text(monkeypatch):
    draw = random.Random(1)
    text = sentence(draw, 900)
    whole = [s for some in simhash.shingles(text, 4) for s in some]
    cut = list(simhash.text_parts(text.encode(), 50))
    assert b"".join(cut) == text.encode() and len(cut) > 20
    monkeypatch.setattr(simhash, "text_parts", lambda data: iter(cut))
    assert [s for some in simhash.shingles(text, 4) for s in some] == whole
    words = text.split()
    assert whole == [" ".join(words[i : i + 4]).encode() for i in range(len(words) - 3)]


def test_posting_lists_meet_every_link():
    """Whatever four positions are shared, some three of the first seven are."""
    for shared in range(256):
        if shared.bit_count() >= simhash.SHARED:
            assert simhash.FIRST_LIST[shared & 127] >= 0
