"""Near copies that share the buckets of all bands are compared in few units."""

import random

from advertlake.llm import near_dedup


def test_a_group_of_near_copies_is_dealt_a_few_times(spark, monkeypatch):
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(400)]
    docs = []
    for i in range(400):
        words = list(base)
        words[r.randrange(400)] = f"x{i}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"v{r.randrange(5000)}" for _ in range(60))) for i in range(100)]
    dealt, verify = [], near_dedup._verify

    def counted(unit, *more):
        dealt.append(unit.count())
        return verify(unit, *more)

    monkeypatch.setattr(near_dedup, "_verify", counted)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == (0 if i < 400 else i) for i in got) and len(got) == 500
    print(dealt)
    assert sum(dealt) < 6 * 400


def test_members_that_stay_apart_meet_each_other_once(spark, monkeypatch):
    """Few texts of a large bucket are alike: what the first pass leaves meets in chunks, in half the rows that all against all takes, and as all pairs would."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(420):
        words = list(base)
        for at in r.sample(range(200), 6 if i < 240 else 1):
            words[at] = f"x{i}-{at}"
        docs.append((i, " ".join(words)))
    dealt, verify = [], near_dedup._verify
    monkeypatch.setattr(near_dedup, "TILE", 16)

    def counted(unit, *more):
        dealt.append(unit.count())
        return verify(unit, *more)

    monkeypatch.setattr(near_dedup, "_verify", counted)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table).collect()}
    monkeypatch.setattr(near_dedup, "TILE", 10_000)
    assert got == {x.doc_id: x.class_id for x in near_dedup.near_duplicates(table).collect()}
    assert len(set(got.values())) > 20 and dealt[1] < 20_000
