"""Classifier and piece sampler against plain versions; token counts against the library on every letter case and range edge."""

import math
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from advertlake.llm import piece_sampling as P
from advertlake.llm import quality_classifier as C
from advertlake.llm import token_counts as T


def test_every_code_point_counts_as_in_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), T.WordBpe(path)
    tok.no_truncation()
    tok.no_padding()
    points = [c for c in [*range(0x30000), *range(0x30000, 0x110000, 97)] if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        texts = [f"Ax{chr(c)}By {chr(c)}{chr(c)}" for c in points[i : i + 4000]]
        assert own.count(texts) == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_odd_texts_count_as_in_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    texts = [None, "", " \t\n", "a", "x" * 40000, "word " * 30000, "<|endoftext|> It's ÀΣΣ Σ's 1234", "ab\x1cab　ab", "a"]
    rows = spark.createDataFrame([(i % 7, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, n_bytes int")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(rows).collect())
    want = [(i % 7, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert got == sorted((a, b, c, c > 2048) for a, b, c in want)


TEXTS = ["good words here good", "bad bad bad thing", "", None, "one", "good good day to you sir", " ".join(f"w{i % 37} w{i % 5}" for i in range(5000)), "bad thing bad thing"]


def test_fast_scores_equal_a_plain_forward_pass():
    rows, labels = 1 << 10, [1, 0, 1, 0, 1, 1, 0, 0]
    texts = [t or "" for t in TEXTS]
    vectors, out, bias = C.learn(texts, labels, rows, 6, 16, 0.5, 3)
    model = C.train(texts, labels, rows, 6, rate=0.5, seed=3)
    for scorer in (C.Scorer(model), C.Scorer(model, memory=12)):  # the second forgets its words all the time
        for text, score in zip(TEXTS, scorer.score(TEXTS), strict=True):
            words, found = (text or "").split(), []
            for w in words:  # a word, its 3- and 4-grams
                ids = C.word_features([w], rows)[0]
                assert len(ids) == 1 + max(0, len(w)) + max(0, len(w) - 1)
                found += [vectors[i].astype(float) for i in ids]
            for a, b in zip(words[:-1], words[1:], strict=True):
                h = C.word_features([a, b], rows)[2]
                found.append(vectors[rows if a == b else C.bigram_rows(h, rows)[0]].astype(float))
            z = out.astype(float) @ (np.mean(found, axis=0) if found else np.zeros(6)) + bias
            assert math.isclose(score, np.exp(z[1]) / np.exp(z).sum(), rel_tol=1e-4)


def test_rejected_documents_go_and_odd_rows_are_scored(spark):
    schema = "doc_id long, text string, score string, _y int, quality int"
    good, bad = "a fine clear sentence about things", "junk junk junk junk junk"
    rows = [(i, f"{good} {i}", "s", 1, 1) for i in range(40)] + [(100 + i, f"{bad} {i}", "s", 1, 1) for i in range(40)]
    rows += [(None, good, None, None, None), (7, bad, None, None, None), (900, None, None, None, None), (901, "", None, None, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (5, None), (6, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, schema)
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None and i < 900} == set(range(40)) and None in ids and ids.count(7) == 1
    scores = {r.doc_id: r.score for r in C.classify(docs, labels).collect()}
    assert scores[900] == scores[901] and 0 < scores[900] < 1


def test_sampled_frequencies_equal_the_posterior_by_enumeration():
    own, text, n = P.pieces("piece_bpe_32k.model", 1.0), " cats", 60000
    known = {b.decode(): i for i, b in enumerate(own.bytes_of) if own.weight[i] and b.decode("utf-8", "ignore") in text and b}

    def ways(rest):
        if not rest:
            return [()]
        return [(known[rest[:k]], *more) for k in range(1, len(rest) + 1) if rest[:k] in known for more in ways(rest[k:])]

    weight = {w: math.exp(sum(own.weight[i] for i in w)) for w in ways(text)}
    got, count = own.lattice(["a", text]).sample(np.ones(n, np.int64), P.mix(np.arange(n, dtype=np.uint64)))
    seen = Counter(tuple(x.tolist()) for x in np.split(got, np.cumsum(count)[:-1]))
    assert len(weight) > 5 and set(seen) <= set(weight)
    for w, share in weight.items():
        p = share / sum(weight.values())
        assert abs(seen[w] - n * p) <= 5 * math.sqrt(n * p) + 5, (w, seen[w], n * p)


def test_decoding_the_encoded_gives_the_texts_back(spark):
    texts = ["Hello  world\n", "", None, "  leading and trailing  ", "émigré 東京 \U0001f600 ▁ x", "\t\x00odd\x7f", "a" * 5000, "one line\r\nand more"]
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in enumerate(texts)] + [(None, "null key", "c", 1), (2, "again", "c", 1)], "doc_id long, text string, pieces string, id int")
    got = P.encode(docs)
    assert all(r.lossless and len(r.pieces) == r.n_pieces for r in got.collect())
    back = Counter((r.doc_id, r.text) for r in P.decode(got).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert P.decode(got.limit(0)).count() == 0
    assert got.withColumn("x", F.col("pieces")).count() == len(texts) + 2


def test_kept_lattices_change_no_draw():
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(30)]
    keys = list(range(30))
    one = P.Pieces(P.pieces("piece_bpe_32k.model").path, 1.0)
    whole = P.encode_block(one, keys, texts, 5)
    assert one.kept
    in_parts = [g for k in range(0, 30, 7) for g in P.encode_block(one, keys[k : k + 7], texts[k : k + 7], 5)]
    assert all((a == b).all() for a, b in zip(whole, in_parts, strict=True))
    assert all(one.decode(g.tolist()) == t for g, t in zip(whole, texts, strict=True))
