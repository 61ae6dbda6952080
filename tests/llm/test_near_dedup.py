"""Near duplicates against all pairs by the operator's own measure: weighted Jaccard similarity of TF-IDF shingles from 0.8 up."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from advertlake.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def classes_of_all_pairs(rows, least=0.8):
    """{row number: smallest id of its component over all pairs}, and the number of pairs at or above `least` between different texts."""
    bags = []
    for _, text in rows:
        w = WORD.findall(text or "")
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(s for b in bags for s in b)
    whole = math.log(max(len(rows), 2))

    def weight(s):
        return 1 + N.IDF_SHARE * min(1, max(0, 1 - round(N._STEP * math.log(df[s])) / N._STEP / whole))

    bags = [{s: n * weight(s) for s, n in b.items()} for b in bags]
    total = [sum(b.values()) for b in bags]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, a in enumerate(bags):
        for j in range(i):
            if a and bags[j] and min(total[i], total[j]) >= least * max(total[i], total[j]):
                small, big = sorted((a, bags[j]), key=len)
                both = sum(min(v, big[s]) for s, v in small.items() if s in big)
                if both >= least * (total[i] + total[j] - both):
                    pairs += rows[i][1] != rows[j][1]
                    root[find(i)] = find(j)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), d), d)
    return {d: first[find(i)] for i, (d, _) in enumerate(rows)}, pairs


def edited(words, edits, rng):
    words = list(words)
    for e in rng.choice(len(words), edits, replace=False):
        words[e] = f"x{rng.integers(10**9)}"
    return " ".join(words)


def test_classes_equal_all_pairs(spark):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want, pairs = classes_of_all_pairs(rows)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < len(rows)


@pytest.mark.parametrize("edits", [(0, 1, 2), (2, 3, 4)])
def test_buckets_of_several_tiles(spark, edits):
    """A group of over TILE near copies, a chain whose ends are not alike, and documents of their own."""
    rng = np.random.default_rng(7)
    words = [f"w{rng.integers(10**6)}" for _ in range(150)]
    rows = [(i, edited(words, int(rng.choice(edits)), rng)) for i in range(500)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(30):
        chain[i * 3] = f"new{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, " ".join(f"own{i}_{k}" for k in range(60))) for i in range(20)]
    want, pairs = classes_of_all_pairs(rows)
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    wrong = [d for d in want if got[d] != want[d]]
    assert pairs > 500 and len(wrong) <= 0.01 * len(rows), (len(wrong), pairs)
    assert all(got[d] == want[d] for d in want if d >= 1000)


def test_long_texts_are_signed_in_slices():
    rng = np.random.default_rng(4)
    h, w = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), None
    w = rng.uniform(1, 9, len(h)).astype(np.float32)
    assert (N.band_keys(h, w, 1 << 20) == N.band_keys(h, w, 700)).all()
