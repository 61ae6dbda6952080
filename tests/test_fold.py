"""Folding equals the rule text by text, and only texts with other letters than ASCII's go to Python."""

import re
import unicodedata

from advertlake.functions import keys as K
from pyspark.sql import functions as F


def test_fold_of_odd_texts(spark):
    texts = [None, "", " A  b\t", "İSTANBUL Işık", "ﬁ½²", "éé", "\U0001f600x", "日本", "\x00a", *[f"plain {i}" for i in range(600)], *[f"çok {i} ğ" for i in range(600)]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", K.fold(F.col("t")).alias("f"))
    want = [None if t is None else re.sub(r"\s+", " ", unicodedata.normalize("NFKD", t.translate(str.maketrans("ıİ", "ii"))).encode("ascii", "ignore").decode().lower()).strip(" ") for t in texts]
    assert {r.i: r.f for r in rows.collect()} == dict(enumerate(want))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_ascii\(CASE WHEN", plan)
