"""Empty tables, nulls, ties, repeated rows and clashing names for the operators and the pipeline's stages."""

import numpy as np
import pytest



from advertlake.llm import (
    common,
    embedding_dedup,
    near_dedup,
    nearest_neighbours,
    piece_sampling,
    quality_classifier,
    sharding,
    source_mixing,
    substring_dedup,
    token_counts,
    url_filter,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g int, id long, kind int, rep long, _n int"
LONG = " ".join(f"w{i}" for i in range(30000))
ROWS = [
    (1, None, None, None, None, 1, 1, 1, 1, 1),
    (2, "", "en", "a", 0, 1, 1, 1, 1, 1),
    (3, " \t\n", "en", "a", 3, 1, 1, 1, 1, 1),
    (4, "one two three four five six seven", "en", "b", 33, 1, 1, 1, 1, 1),
    (4, "one two three four five six seven", "en", "b", 33, 1, 1, 1, 1, 1),
    (5, "one two three four five six seven", "en", None, 33, 1, 1, 1, 1, 1),
    (6, LONG, "en", "b", len(LONG), 1, 1, 1, 1, 1),
    (None, "null id € \U0001f600", "en", "c", 9, 1, 1, 1, 1, 1),
]
OPERATORS = {
    "tokens": token_counts.token_counts,
    "mix_plan": source_mixing.mixing_plan,
    "mix": source_mixing.mix,
    "repeats": substring_dedup.remove_repeats,
    "digest": substring_dedup.digest,
    "pieces": piece_sampling.encode,
    "near": near_dedup.near_duplicates,
    "near_kept": near_dedup.deduplicated,
    "shards": sharding.shard_by_bytes,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_documents(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_documents(spark, name):
    got = OPERATORS[name](spark.createDataFrame(ROWS, DOCS)).collect()
    if name == "near_kept":
        assert sorted(r.doc_id for r in got if r.doc_id)[:3] == [1, 2, 3] and 5 not in {r.doc_id for r in got}
    elif name != "mix":
        assert len(got) == len(ROWS)


def test_texts_of_null_and_repeated_ids_are_compared(spark):
    def text(name, edit=None):
        return " ".join(edit if edit and i == 60 else f"{name}{i}" for i in range(120))

    rows = [
        (None, text("a")), (None, text("b")), (None, text("c")), (None, text("e")), (None, text("e", "x")), (None, text("f")), (None, text("f")),
        (1, text("b", "x")), (2, text("b", "y")), (3, text("c")), (4, text("a")),  # near copies and copies of the null ids' texts
        (7, text("g")), (7, text("h")), (8, text("g", "x")), (9, text("h", "x")), (6, text("h", "y")),  # one id, two texts
        (10, text("k")), (10, text("k", "x")), (11, text("m")), (11, text("m")), (12, text("m", "x")),  # one id, all of one class
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    classes = [(None, 4), (None, 1), (None, 3), (None, None), (None, None), (None, None), (None, None), (1, 1), (2, 1), (3, 3), (4, 4)]
    classes += [(7, 7), (7, 6), (8, 7), (9, 6), (6, 6), (10, 10), (10, 10), (11, 11), (11, 11), (12, 11)]
    assert sorted(map(str, classes)) == sorted(str((r.doc_id, r.class_id)) for r in got)
    assert sorted(str(r.class_id) for r in got if r.kept) == sorted(map(str, [None, None, 1, 3, 4, 6, 7, 10, 11]))
    left = near_dedup.deduplicated(docs).collect()
    sure = {(1, text("b", "x")), (3, text("c")), (4, text("a")), (6, text("h", "y")), (7, text("g")), (11, text("m"))}
    assert len(left) == 9 and sure <= {tuple(r) for r in left} and (None, text("f")) in left
    assert sorted(r.text[0] for r in left) == sorted("bcahgkmef")


def test_components_are_finished_or_refused(spark):
    chain = spark.createDataFrame([(i * 37 % 101, (i + 1) * 37 % 101) for i in range(100)], "a long, b long")
    assert {(r.node, r.component) for r in common.connected_components(chain).collect()} == {(i, 0) for i in range(101)}
    with pytest.raises(RuntimeError):
        common.connected_components(chain, max_rounds=1)


@pytest.mark.parametrize("small", [0, 200_000])
def test_components_equal_union_find(spark, monkeypatch, small):
    monkeypatch.setattr(common._with_minima, "__defaults__", (4, small))
    rng = np.random.default_rng(small)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(0, int(i)) for i in range(500, 900)] + [(i, i + 1) for i in range(900, 960)] + [(None, 3), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


def test_classifier_without_labels_or_documents(spark):
    docs, none = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, none).count() == len(ROWS)
    some = spark.createDataFrame([(2, None, 0), (4, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, some).count() == len(ROWS)
    assert quality_classifier.classify(docs.limit(0), some).count() == 0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.com/en/1", None),
        (2, "http://b.info/x", link.format("http://a.com/en/1")),
        (3, "HTTP://Sub.Example.COM/en/77?q", ""),
        (4, "http://x.example.net/de/81", ""),
        (5, "http://y.net/de/8", ""),
        (6, None, None),
        (7, "no scheme", link.format("http://a.com/en/1")),
        (8, "http://b.info/clean", ""),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["block", "block", "allow", "block", "allow", "allow", "allow", "allow"]
    assert got[3].rule == "example.com/en/7" and got[4].rule == "example.net/de/8" and got[6].host == "" and got[2].rule is None
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


VECTORS = [
    (0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.99, 0.01], 1), (3, [0.0, 1.0], 1), (4, None, 1), (5, [0.0, 0.0], 1),
    (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 2), (10, [float("inf"), 1.0], 1),
]


def test_odd_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(v).collect()}
    assert len(got) == len(VECTORS) and [got[i].n_links for i in range(4)] == [2, 2, 2, 0]
    assert {got[i].component_id for i in range(3)} == {0} and all(got[i].n_links == 0 and got[i].kept for i in range(4, 11))
    near = sorted(nearest_neighbours.neighbours(v).collect(), key=lambda r: r.rank)
    assert [(r.query_id, r.vec_id) for r in near] == [(0, 1), (0, 8), (0, 9), (0, 2), (0, 3)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_duplicates(empty).count() == 0 and nearest_neighbours.neighbours(empty).count() == 0




def test_values_of_odd_documents(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    tokens = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect()))
    assert [t[:2] for t in tokens] == [(-1, 16), (1, 0), (2, 0), (3, 3), (4, 33), (4, 33), (5, 33), (6, len(LONG))] and [t[2] for t in tokens[1:4]] == [0, 0, 0] and tokens[4][2] == tokens[5][2] == tokens[6][2] == 7
    cut = substring_dedup.digest(spark.createDataFrame([*ROWS, (9, LONG, "en", "b", 1, 1, 1, 1, 1, 1)], DOCS)).collect()
    removed = {(r.doc_id, r.n_words): r.n_removed for r in cut}
    assert removed[(6, 30000)] == 0 and removed[(9, 30000)] == 30000 and removed[(1, 0)] == 0 and removed[(5, 7)] == 0
    plan = {(r.doc_id, r.size) for r in source_mixing.mixing_plan(docs).collect()}
    assert plan == {(1, 0), (2, 0), (3, 0), (4, 7), (5, 7), (6, 30000), (None, 4)}
    shards = sharding.shard_by_bytes(docs).collect()
    assert sorted(r.size for r in shards) == sorted([8, 8, 11, 41, 41, 41, len(LONG) + 8, 24])


def test_a_large_group_of_equal_texts_is_cut(spark):
    rows = [(i, "the same text in many documents") for i in range(3000)] + [(5000 + i, f"own text number {i}") for i in range(1500)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    per, slots = {}, {}
    for r in got:
        per[r.shard] = per.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(per.values()) / 24
    assert len(got) == len(rows) and len(per) == 24 and max(abs(v - mean) for v in per.values()) <= 0.1 * mean
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_small_groups_of_equal_texts_stay_whole(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"text {g} " + "x" * int(60 + g % 40)) for i, g in enumerate(rng.integers(0, 900, 4000))] + [(9000 + i, "hot " * 20) for i in range(1500)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text, per, of = dict(rows), {}, {}
    for r in got:
        per[r.shard] = per.get(r.shard, 0) + r.size
        of.setdefault(text[r.doc_id], set()).add(r.shard)
    mean = sum(per.values()) / 24
    size = {t: sum(len(t) + 8 for _, u in rows if u == t) for t in of}
    assert len(got) == len(rows) and all(len(s) == 1 for t, s in of.items() if size[t] <= 0.05 * mean) and len(of["hot " * 20]) > 5
    assert max(abs(v - mean) for v in per.values()) <= 0.06 * mean
