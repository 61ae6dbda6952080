"""Advert texts worked by hand, and the streams' rules on odd lines."""

import itertools
import time
from re import _constants as C
from re import _parser as parser

from advertlake.functions import advert_text as A
from advertlake.streaming.ingest import parse_lines
from pyspark.sql import functions as F


def _one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_flags_negations_and_null(spark):
    t = F.col("t")
    assert _one(spark, "PERT", A.scan(t, A.BLOCKING))[0] == ["pert/ağır hasar"]
    assert _one(spark, "pert kaydı yok, senet istenmez", A.scan(t, A.BLOCKING))[0] == []
    assert _one(spark, "şacil değil", A.scan(t, A.URGENCY))[0] == []
    assert _one(spark, "ACİL, pazarlık payı var", A.scan(t, A.URGENCY))[0] == ["acil", "pazarlık"]
    assert _one(spark, None, A.scan(t, A.BLOCKING))[0] == []


def test_costs_steering_and_sold(spark):
    t = F.col("t")
    assert _one(spark, "aracın masrafları vardır", A.cost_unknown(t))[0] is True
    assert _one(spark, "ufak tefek masrafı var", A.cost_unknown(t))[0] is False
    assert _one(spark, None, A.cost_unknown(t))[0] is False
    assert [_one(spark, x, A.steering(t))[0] for x in ("Sol direksiyon", "RHD", "lhd rhd", "", None)] == ["LHD", "RHD", None, None, None]
    assert _one(spark, "SATILDI İlan No: 4567", A.sold_number(t))[0] == "4567"
    assert _one(spark, "İlan No: 4567", A.sold_number(t))[0] is None


def test_lines_with_odd_values(spark):
    good = '{"surum":1,"platform":"facebook","anahtar":"fb:a","gonderi":"1","metin":"x","paylasim_utc":"2026-01-02T00:00:00","goruldu_utc":"2026-01-01T00:00:00"}'
    rows = parse_lines(spark.createDataFrame([(x,) for x in (good, "", "{", "{}", "[1]", None, good.replace("fb:a", "a"))], "value string")).collect()
    assert [r.reason for r in rows] == [None, "bozuk_satir", "bozuk_satir", "surum", "bozuk_satir", "bozuk_satir", "alan"]
    assert rows[0].dated is False and rows[0].posted_at == rows[0].seen_at  # a post later than its sighting loses its time


def _written(tokens):
    """Ways to write what a pattern matches: every choice, and every repeat at its least and once more."""
    ways = [""]
    for kind, v in tokens:
        if kind is C.LITERAL:
            some = [chr(v)]
        elif kind is C.IN:
            some = [chr(x) if k is C.LITERAL else {C.CATEGORY_SPACE: " ", C.CATEGORY_DIGIT: "7", C.CATEGORY_NOT_WORD: "-"}[x] for k, x in v]
        elif kind is C.BRANCH:
            some = [w for branch in v[1] for w in _written(branch)]
        elif kind is C.SUBPATTERN:
            some = _written(v[3])
        elif kind is C.MAX_REPEAT:
            low, high, inner = v
            some = sorted({"".join(x) for n in {low, min(low + 1, high)} for x in itertools.product(_written(inner), repeat=min(n, 3))})
        elif kind is C.ANY:
            some = ["x"]
        elif kind in (C.AT, C.ASSERT_NOT):
            some = [""]
        else:
            raise AssertionError(kind)
        ways = [a + b for a in ways for b in some]
    return ways


def test_every_match_holds_a_stem(spark):
    rules = [p for t in (A.BLOCKING, A.PLATE, A.WARNING, A.URGENCY) for p in t.values()]
    lower, free = [*rules, A.CUSTOMS_OK, A.COST_UNKNOWN], [A.LEFT_HAND, A.RIGHT_HAND, A.SOLD, A.ADVERT_NO]
    assert set(A.STEMS) == {*lower, *free}
    for p in lower:
        for w in _written(parser.parse(p.replace(r"\d{3,8}", r"\d"))):
            assert any(x in w for x in A.STEMS[p]), (p, w)
    for p in free:  # in every letter that a pattern without case takes for the same
        ways = _written(parser.parse(p.replace(r"\d{3,8}", r"\d{3}").replace(r"\W{0,4}", "")))
        odd = {x for w in ways for x in (w, w.upper(), w.replace("i", "İ").replace("s", "ſ").replace("k", "\u212a"), w.replace("i", "I"), w.replace("i", "ı").replace("S", "ſ"))}
        t = F.col("t")
        got = spark.createDataFrame([(x,) for x in sorted(odd)], "t string").select("t", t.rlike(f"(?iU)(?:{p})").alias("m"), A._holds(A._plain(A.lowered(t)), p).alias("h")).collect()
        assert all(r.h or not r.m for r in got) and sum(r.m for r in got) > len(ways) / 2


def test_stems_change_no_answer(spark):
    """Words of the rules in any order and case: every answer is that of the patterns alone."""
    import random

    rng, t = random.Random(5), F.col("t")
    tables = (A.BLOCKING, A.PLATE, A.WARNING, A.URGENCY)
    words = [w for d in tables for p in d.values() for w in _written(parser.parse(p))[:40]] + [w for p in (A.LEFT_HAND, A.RIGHT_HAND, A.SOLD, A.CUSTOMS_OK) for w in _written(parser.parse(p))]
    words += [*["Satıldı İlan No: 4567"] * 9, "İlan No: 4567", "ilan numarası 123", "yok", "değil", "ufak", "x"]
    texts = [" ".join(rng.choice([str.upper, str, str.title])(rng.choice(words)) for _ in range(rng.randrange(1, 5))) for _ in range(800)]
    low = A.tr_lower(t)
    plain = [F.array_compact(F.array(*[F.when(low.rlike(f"(?U)(?:{p})"), n) for n, p in d.items()])) for d in tables]
    left, right = t.rlike(f"(?iU)(?:{A.LEFT_HAND})"), t.rlike(f"(?iU)(?:{A.RIGHT_HAND})")
    n = F.regexp_extract(t, f"(?iU){A.ADVERT_NO}", 1)
    plain += [F.when(left & ~right, "LHD").when(right & ~left, "RHD"), F.when(t.rlike(f"(?iU)(?:{A.SOLD})") & (n != ""), n), low.rlike(f"(?U)(?:{A.CUSTOMS_OK})")]
    ours = [*[A.scan(t, d, A.lowered(t)) for d in tables], A.steering(t, A.lowered(t)), A.sold_number(t, A.lowered(t)), A.customs_stated(t)]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.array(*[F.to_json(F.struct(c.alias("v"))) for c in plain]).alias("p"), F.array(*[F.to_json(F.struct(c.alias("v"))) for c in ours]).alias("o")).collect()
    assert [r for r in rows if r.p != r.o] == []
    assert [i for i in range(len(ours)) if len({r.o[i] for r in rows}) < 2] == []


def test_many_costs_take_no_square_of_time(spark):
    """Every mention is small, so that none ends the search: 12,000 of them took minutes when each gathered all text before it."""
    text = "ufak masraf var " * 12_000
    began = time.time()
    assert _one(spark, text, A.cost_unknown(F.col("t")))[0] is False
    assert _one(spark, text + "x" * 30 + " masrafı var", A.cost_unknown(F.col("t")))[0] is True
    assert time.time() - began < 30
