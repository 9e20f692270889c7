import hashlib
from collections import defaultdict

import numpy as np

from chronofid.llm import line_dedup


def brute(rows, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for key in {line_dedup.line_key(x) for x in (text or "").split("\n")}:
            holders[key].append(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = []
        for x in lines:
            key = line_dedup.line_key(x)
            known = [d for d in holders[key] if d is not None]
            gone.append(len(key) >= min_chars and len(holders[key]) >= min_docs and bool(known) and doc_id != max(known))
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((doc_id, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    long_ = "The very same long line, found in a good many texts"
    rows = [(i, f"own {i}\n  {long_.upper() if i % 2 else long_}\t\nshort\n{long_}") for i in range(9)]
    rows += [(20 + i, f"ä{'é' * 39}\nrest\r\n\n") for i in range(5)] + [(30 + i, f"{'é' * 39}\nrest") for i in range(5)]
    rows += [(40 + i, "only four documents hold this line of some length") for i in range(4)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, long_), (None, long_ + "\nmore"), (8, rows[8][1]), (7, "another text\n" + long_), (60, (long_ + "\n") * 3000)]
    got = line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_messy_and_empty(messy, messy_rows, nothing):
    got = line_dedup.line_digests(messy).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([r[:2] for r in messy_rows])
    assert line_dedup.line_digests(nothing[0]).count() == 0


def test_perfect_hash_is_minimal_and_survives_packing():
    keys = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)
    hashed = line_dedup.PerfectHash.unpacked(*line_dedup.PerfectHash.over(keys).packed())
    assert sorted(hashed.places(keys)) == list(range(len(np.unique(keys))))
