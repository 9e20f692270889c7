import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from chronofid.llm import collocations


def counted(rows):
    f = defaultdict(Counter)
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f


def brute(rows, least, top):
    out = []
    for lang, f in counted(rows).items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        grams = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        longer = Counter()
        for g, c in grams.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        longer[g[i:j]] = max(longer[g[i:j]], c)
        found = []
        for g, a in grams.items():
            if 100 * longer[g] >= 80 * a:
                continue
            score, cut = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def got(docs, **how):
    return sorted(tuple(r)[:8] for r in collocations.collocations(docs, **how).collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = ["new", "york", "City", "of", "the", "é", "naïve", "x\x00y", "a b", "tab\there", "p.q", "end!", "nbsp word"]
    return [(draw.choice([" ", "\t ", "\n"]).join(draw.choices(words, k=draw.randint(0, 60))), draw.choice(["en", "en", "de", None, "und"])) for _ in range(300)]


@pytest.mark.parametrize("least, top, split", [(2, 10_000, 64), (5, 40, 500), (8, 7, 1 << 22)])
def test_equals_counting_by_hand(spark, rows, monkeypatch, least, top, split):
    monkeypatch.setattr(collocations, "PARTITION_BYTES", split)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    want = brute(rows, least, top)
    assert got(docs, min_count=least, top=top) == want and len(want) > 10


def test_messy_and_empty(messy, messy_rows, nothing):
    assert got(messy, min_count=3) == brute([(r[1], r[2]) for r in messy_rows], 3, 2000)
    assert collocations.collocations(nothing[0]).count() == 0


def test_stretches_count_every_phrase_once(monkeypatch, rows):
    monkeypatch.setattr(collocations, "STRETCH", 7)
    monkeypatch.setattr(collocations, "PART", 11)
    table = pa.table({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})
    found = defaultdict(Counter)
    for s in collocations.stretches(iter(table.to_batches(50))):
        for k, ok in enumerate(s.starts()):
            for i in np.flatnonzero(ok):
                found[s.names[s.langs[i]]][tuple(s.words[w].decode() for w in s.ids[i : i + k + 1])] += 1
    assert found == counted(rows)


@pytest.mark.parametrize("capacity", [1, 4])
def test_what_is_frequent_survives_any_merging(monkeypatch, capacity):
    monkeypatch.setattr(collocations, "WAITING", 50)
    for seed in range(20):
        draw = np.random.default_rng(seed)
        keys = np.concatenate([draw.integers(0, 5000, 4000), draw.zipf(1.3, 4000) % 5000])
        draw.shuffle(keys)
        true = np.bincount(keys, minlength=5000)
        summary = collocations.Summary(capacity * len(keys) // 30 + 1)
        for part in np.array_split(keys, 60):
            summary.add(*np.unique(part, return_counts=True))
        left = summary.survivors(30)
        assert set(np.flatnonzero(true >= 30)) <= set(left)
        assert summary.error < 30 / capacity and len(left) <= summary.capacity
        assert (true[left] + summary.error >= 30).all()


def test_hashes_that_collide_do_not_mix_counts(monkeypatch, rows):
    """With all hashes equal, phrases are told apart by their words."""

    class Shared:
        value = np.full(1024, -1, np.int64)

    monkeypatch.setattr(collocations.Stretch, "hashes", lambda s: [np.zeros(len(s.ids) - k, np.uint64) for k in range(4)])
    table = pa.table({"text": [t for t, _ in rows], "lang": [x for _, x in rows]})
    found = defaultdict(Counter)
    for batch in collocations._summed(collocations._counted(iter(table.to_batches()), Shared, 0), 1):
        for r in batch.to_pylist():
            found[r["lang"]][tuple(r["phrase"].split(" "))] += r["f"]
    for lang, f in counted(rows).items():
        assert found[lang].pop(("",)) == sum(c for g, c in f.items() if len(g) == 1) and found[lang] == f


def test_counts_beyond_64_bits_in_products(spark, monkeypatch):
    big = 9_000_000_000_000_000_000
    counts = [("en", "", big), ("en", "a", big), ("en", "b", big - 1), ("en", "a b", big - 2)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *_: spark.createDataFrame(counts, "lang string, phrase string, f long"))
    assert got(None) == [("en", 1, "a b", big - 2, big, big - 1, big, 2_000_000 * (big - 2) // (2 * big - 1))]


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 2**32 - 1, 7])
    assert (collocations.unpacked(collocations.packed(x)) == x).all()
