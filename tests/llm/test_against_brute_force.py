"""The corpus operators against brute force on the small tables."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from advertlake.llm import queries as Q
from advertlake.llm import source_mixing

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").collect()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    good = [r for r in rows if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    return rows, [r.vec_id for r in good], np.array([r.embedding for r in good], np.float64), [r.label for r in good]


def test_token_counts_equal_the_library(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    want = {d.doc_id: len(tok.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
    got = Q.op1_token_counts(spark, SMALL).collect()
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((d.text or "").encode()) for r, d in zip(sorted(got), sorted(docs), strict=True))
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_quality_ranks_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = Q.op2_quality_classifier(spark, sf).collect()
    held = [(r.score, labels[r.doc_id]) for r in got if r.doc_id in labels and labels[r.doc_id] is not None and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([(s >= 0.3) == bool(y) for s, y in held])
    print("held-out AUC", auc, "accuracy", right)
    assert auc > 0.9 and right > 0.85


def test_mix_comes_near_its_targets(spark, docs):
    rows = Q.op3_source_mixing(spark, SMALL).collect()
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    taken, goal = defaultdict(int), {}
    for r in rows:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = (r.target, r.source_size)
    assert math.isclose(sum(t for t, _ in goal.values()), 1.5 * sum(size.values()), rel_tol=1e-9)
    assert all(t <= 2 * s + 1e-6 for t, s in goal.values())
    assert rows == Q.op3_source_mixing(spark, SMALL).collect()
    # a draw of its own per document: five standard deviations of the fractional copies, with the largest documents counted
    for s, (target, whole) in goal.items():
        part = target / whole - math.floor(target / whole)
        spread = math.sqrt(part * (1 - part) * sum(size[d] ** 2 for d in size if source[d] == s))
        assert abs(taken[s] - target) <= 5 * spread + 1, (s, taken[s], target)


@pytest.mark.parametrize("ids", ["none", "one"])
def test_rows_without_an_id_of_their_own_are_mixed_by_their_texts(spark, ids):
    rows = [(None if ids == "none" else 7, " ".join(["w"] * 20) + f" {i}", "s" if i % 4 else "t") for i in range(2000)]
    plan = source_mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in plan:
        by[r.source_size].append(r)
    for part in by.values():
        assert abs(sum(r.taken for r in part) - part[0].target) <= 0.08 * part[0].target


def test_neighbours_reach_the_recall(spark, vectors):
    _, ids, m, _ = vectors
    got = defaultdict(dict)
    for r in Q.op5_nearest_neighbours(spark, SMALL).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    hit = n = 0
    for q, v in zip(ids, m, strict=True):
        if q % 100:
            continue
        d = np.sqrt(((m - v) ** 2).sum(1))
        want = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if ids[i] != q][:10]
        mine = [got[q][k] for k in sorted(got[q])]
        assert mine == sorted(mine, key=lambda x: (x[1], x[0])) and sorted(got[q]) == list(range(1, len(mine) + 1))
        assert all(math.isclose(s, d[ids.index(i)], rel_tol=1e-9, abs_tol=1e-9) for i, s in mine)
        hit += len({i for i, _ in mine} & set(want))
        n += len(want)
    assert hit / n >= 0.9


def test_repeats_are_removed_exactly(spark, docs):
    k, first, at = 20, {}, []
    for d in sorted(docs, key=lambda d: d.doc_id):
        w = WORD.findall(d.text or "")
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            if first.setdefault(key, (d.doc_id, i)) != (d.doc_id, i):
                gone[i : i + k] = [True] * k
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        at.append((d.doc_id, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted(tuple(r) for r in Q.op6_substring_dedup(spark, SMALL).collect()) == at
    assert sum(x[2] for x in at) > 0


def test_sampled_pieces_are_lossless_and_reproducible(spark, docs):
    one, two = (sorted(Q.op7_piece_sampling(spark, SMALL).collect()) for _ in range(2))
    assert one == two and len(one) == len(docs) and all(r.lossless for r in one)


def test_near_duplicates_share_a_class(spark, docs):
    bags = {}
    for d in docs:
        w = WORD.findall(d.text or "")
        bags[d.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    got = {r.doc_id: r for r in Q.op8_near_dedup(spark, SMALL).collect()}
    ids = sorted(bags)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(bags[a] & bags[b])
            if both and both / len(bags[a] | bags[b]) >= 0.87:  # far enough above 0.8 for the weighted similarity to agree
                assert got[a].class_id == got[b].class_id, (a, b)
    for i in ids:  # nobody joins a class without a member that is similar to them
        if got[i].class_id != i:
            near = max(len(bags[i] & bags[j]) / len(bags[i] | bags[j]) for j in ids if j != i and got[j].class_id == got[i].class_id)
            assert near >= 0.7
    assert all(r.kept == (r.class_id == r.doc_id) for r in got.values())


def test_shards_are_even_and_gapless(spark, docs):
    rows = Q.op9_sharding(spark, SMALL).collect()
    size = {d.doc_id: len((d.text or "").encode()) + 8 for d in docs}
    crc = {d.doc_id: zlib.crc32((d.text or "").encode()) for d in docs}
    per, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in rows:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], crc[r.doc_id], "bytes", None) and 0 <= r.shard < 24
        per[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len(rows) == len(docs)
    mean = sum(size.values()) / 24
    assert max(abs(per[s] - mean) for s in range(24)) <= max(0.1 * mean, max(size.values()))


def test_embedding_links_equal_all_pairs(spark, vectors):
    rows, ids, m, labels = vectors
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    cos = unit @ unit.T
    links, root = defaultdict(set), {r.vec_id: r.vec_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(cos[i] >= 0.93):
            if i != j and labels[i] is not None and labels[i] == labels[j]:
                links[ids[i]].add(ids[j])
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    got = {r.vec_id: r for r in Q.op10_embedding_dedup(spark, SMALL).collect()}
    assert {i: r.n_links for i, r in got.items()} == {r.vec_id: len(links[r.vec_id]) for r in rows}
    assert {i: r.component_id for i, r in got.items()} == {r.vec_id: find(r.vec_id) for r in rows}
