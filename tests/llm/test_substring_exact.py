"""Substring dedup on words that are built to collide, and on tables whose ids say little."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from advertlake.llm import common, substring_dedup
from advertlake.llm.exchange import batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _thue_morse(n):
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_built_to_collide(spark, n):
    a, b = _thue_morse(n)
    first, second = common.word_hashes([f"{w} x".encode() for w in (a, b)])
    assert first[2][0] != second[2][0] and first[3][0] != second[3][0] and first[2][1] == second[2][1]
    shared = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{shared} {a}"), (2, f"{shared} {b}"), (3, f"{shared} {a}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.digest(docs).collect()} == {1: 0, 2: 0, 3: 20}


def test_words_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(0)
    texts = ["".join(rng.choices("ab \t\n\x0b\x0c\r\x1c\x85\xa0é　", k=rng.randrange(40))) for _ in range(300)]
    texts[7] = "ab " * 40 + "x" * 90
    known: dict[str, tuple] = {}
    for size in (1 << 20, 64):  # many texts at a time, and long ones in slices
        monkeypatch.setattr(common, "_SLICE", size)
        for text, (start, end, one, two) in zip(texts, common.word_hashes(t.encode() for t in texts), strict=True):
            words = WORD.findall(text)
            assert [text.encode()[a:z].decode() for a, z in zip(start, end, strict=True)] == words
            assert all(known.setdefault(w, h) == h for w, h in zip(words, zip(one, two, strict=True), strict=True))
    assert len({h for h, _ in known.values()}) == len({h for _, h in known.values()}) == len(known)


@pytest.mark.parametrize("share", [1.0, 0.4])
def test_rows_without_or_with_one_id_fill_many_batches(spark, share):
    rng = random.Random(int(share * 10))
    passages = [" ".join(f"p{k}x{i}" for i in range(rng.randint(20, 60))) for k in range(12)]
    rows = []
    for i in range(260):
        words = [f"u{i}y{j}" for j in range(400)]
        for p in rng.sample(passages, 2):
            at = rng.randrange(len(words))
            words[at:at] = p.split()
        rows.append((None if rng.random() < share else 7 if rng.random() < 0.5 else i, " ".join(words)))
    rows += [(None, rows[0][1]), (None, None), (None, ""), (7, rows[1][1]), (7, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert batches(docs)[0] > 1
    marked = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).collect()
    first, want = set(), []
    for r in sorted(marked, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.mark, r.text or "")):
        w = WORD.findall(r.text or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in first:
                gone[i : i + 20] = [True] * 20
            first.add(key)
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r.doc_id, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in substring_dedup.digest(docs).collect())
