"""The pipeline's stages against brute force, each on its predecessor's rows, and on odd rows."""

import re
from collections import Counter

import corpus_pipeline
import pytest

from advertlake.llm import pipeline as L
from advertlake.llm import piece_sampling, quality_classifier, source_mixing
from test_near_dedup import classes_of_all_pairs

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, g int, _n int, row long"


def test_names():
    assert corpus_pipeline.STAGES is L.STAGES and corpus_pipeline.run is L.run and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in L.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "pieces"]


def test_each_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, rows = docs.columns, [tuple(r) for r in docs.collect()]
    text = columns.index("text")

    model = quality_classifier.fit(docs, labels.filter(~quality_classifier.held_out(labels["doc_id"])), 3000)
    scores = quality_classifier.Scorer(model).score([r[text] for r in rows])
    want = [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]
    good = L.quality(spark, docs, SMALL)
    rows = [tuple(r) for r in good.collect()]
    assert good.columns == columns and Counter(rows) == Counter(want) and len(want) < len(scores)

    classes, _ = classes_of_all_pairs([(r[0], r[text]) for r in rows])
    want = [r for r in rows if classes[r[0]] == r[0]]
    alone = L.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), SMALL)
    assert alone.columns == columns and Counter(map(tuple, alone.collect())) == Counter(want) and len(want) < len(rows)
    rows = want

    seen, want = {}, {}
    for r in sorted(rows):
        w = WORD.findall(r[text] or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if seen.setdefault(tuple(w[i : i + 20]), (r[0], i)) != (r[0], i):
                gone[i : i + 20] = [True] * 20
        want[r[0]] = [x for x, g in zip(w, gone, strict=True) if not g]
    cut = L.repeated_passages(spark, spark.createDataFrame(rows, docs.schema), SMALL)
    got = cut.collect()
    assert cut.columns == columns and {r.doc_id: WORD.findall(r.text or "") for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    rows = [tuple(r) for r in got]

    taken = {r.doc_id: r.taken for r in source_mixing.mixing_plan(spark.createDataFrame(rows, docs.schema)).collect()}
    mixed = L.source_mix(spark, spark.createDataFrame(rows, docs.schema), SMALL)
    counts = Counter(map(tuple, mixed.collect()))
    assert mixed.columns == columns and all(counts[r] * len(WORD.findall(r[text] or "")) == taken[r[0]] for r in rows)

    encoded = L.pieces(spark, mixed, SMALL)
    assert encoded.columns == ["doc_id", "pieces", "n_pieces", "lossless"] and all(r.lossless for r in encoded.collect())
    back = Counter((r.doc_id, r.text) for r in piece_sampling.decode(encoded).collect())
    assert back == Counter((r.doc_id, r.text or "") for r in mixed.collect())


ODD = [
    (1, None, None, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1.0, "k", 1, 1, 1),
    (3, "one two three four five six seven", "en", "b", 33, 1.0, "k", 1, 1, 1),
    (3, "one two three four five six seven", "en", "b", 33, 1.0, "k", 1, 1, 1),
    (None, "one two three four five six seven", "en", "b", 33, 1.0, "k", 1, 1, 1),
    (None, " ".join(f"w{i}" for i in range(20000)), None, None, 1, 1.0, "k", 1, 1, 1),
]


@pytest.mark.parametrize("name", [n for n, _ in L.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, name):
    stage, docs = dict(L.STAGES)[name], spark.createDataFrame(ODD, SCHEMA)
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    out = stage(spark, docs, SMALL)
    got = [tuple(r) for r in out.collect()]
    assert name == "pieces" or out.columns == docs.columns
    if name == "near_duplicates":
        assert Counter(r[0] for r in got) == {1: 1, 2: 1, 3: 1, None: 1} and next(r for r in got if r[0] is None)[1] == ODD[5][1]
    if name == "repeated_passages":
        assert Counter((r[0], r[1]) for r in got) == Counter((r[0], r[1]) for r in ODD)
        assert {r[4] for r in got if r[0] is None} == {33, len(ODD[5][1])} and next(r for r in got if r[0] == 1)[4] is None
    if name == "source_mix":
        assert set(got) <= set(ODD) and len(got) >= 4
    if name == "pieces":
        assert len(got) == len(ODD) and all(r[3] for r in got)
