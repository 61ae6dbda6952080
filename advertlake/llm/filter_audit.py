"""Filter interaction audit by a subset-zeta transform, in DataFrame functions only.

Every document gets the set of the filters that it fails, as a mask of five bits. The counts per part and mask (32 numbers, and as many for good and
for toxic documents) are all that the audit needs: summed over the subsets of each mask, they tell how many documents fail none but the filters of
that subset, so the survivors of a set of filters are the entry of its complement, and a step of an order is the difference of two neighbours. So
the 120 orders cost nothing that grows with the corpus.

Words are [^\\x20\\x09-\\x0D]+. Filters: A under 100 words; B 100 * distinct words < 80 * words; C 100 * [A-Z] > 10 * code points; D any of #$%&*|;
E identical to the text of any smaller doc_id. A null text is empty. A null doc_id has no label, no smaller id and is smaller than none, so it passes
E and makes no other text fail; rows that repeat a doc_id with one text are judged alike. A document is good or toxic if any of its label rows says
1. A null lang is the part ''. Texts are compared by their SHA-256. Texts of any length are read whole. Only doc_id, text and lang are read, so other
columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import spread_join, written

FILTERS = "ABCDE"
_ALL = (1 << len(FILTERS)) - 1
_SPACE = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """The mask of A to D (bits 0 to 3), which a text fails or passes by itself."""
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 100, F.lit(100) * distinct < F.lit(80) * n, F.lit(100) * capitals > F.lit(10) * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0)).cast("int")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters. Rows of one id, text and part are counted before they are joined,
    labels go to their documents by a salted join, and a text's smallest id is a minimum with partial sums: no group is gathered."""
    text = F.coalesce("text", F.lit(""))
    lean = written(
        docs.select(F.col("doc_id").alias("d"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), F.coalesce("lang", F.lit("")).alias("part"), own_failures(text).alias("own"))
        .groupBy("d", "key", "part", "own")
        .agg(F.count("*").alias("rows"))
    )
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("d")).agg(F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic"))
    first = lean.filter("d is not null").groupBy("key").agg(F.min("d").alias("d")).withColumn("first", F.lit(True))
    rows = spread_join(lean, known, "d").join(first, ["key", "d"], "left")
    again = F.col("d").isNotNull() & F.col("first").isNull()

    def total(of: str) -> Column:
        return F.sum(F.when(F.col(of), F.col("rows")).otherwise(0))

    mask = F.col("own") + F.when(again, 1 << 4).otherwise(0)
    return rows.groupBy("part", mask.alias("mask")).agg(F.sum("rows").alias("n"), total("is_good").alias("good"), total("is_toxic").alias("toxic"))


def _zeta(counts: Column, of: str) -> Column:
    """Sums over the subsets of each mask: one pass per bit over 32 numbers. counts: a map from mask to counts."""
    start = F.transform(F.sequence(F.lit(0), F.lit(_ALL)), lambda m: F.coalesce(F.try_element_at(counts, m)[of], F.lit(0)).cast("long"))

    def add(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(bit) > 0, F.get(sums, i - bit)).otherwise(F.lit(0)))

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), start, add)


def _orders() -> list[dict]:
    """Each step of each order: the filter's bit, and the complements of the sets applied before and after it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        left = _ALL
        for step, k in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[i] for i in order), "step": step, "f": k, "before": left, "after": left & ~(1 << k)})
            left &= ~(1 << k)
    return out


def _over_all_orders(z: Column, k: int) -> Column:
    """What filter k removes, summed over all orders: by the set of filters before it, |set|! * (4 - |set|)! orders each."""
    others, terms = [i for i in range(len(FILTERS)) if i != k], []
    for size in range(len(FILTERS)):
        for s in combinations(others, size):
            left = _ALL & ~sum(1 << i for i in s)
            terms.append((z[left] - z[left & ~(1 << k)]) * F.lit(factorial(size) * factorial(len(others) - size)))
    return sum(terms[1:], terms[0])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module's text."""
    per = F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic"))))
    sums = mask_counts(docs, labels).groupBy("part").agg(per.alias("c"))  # at most 32 entries
    sums = written(sums.select("part", *[_zeta(F.col("c"), of).alias(of) for of in ("n", "good", "toxic")]))
    z = F.col("n")
    alone = F.array(*[z[_ALL] - z[_ALL & ~(1 << k)] for k in range(len(FILTERS))])  # that fail the filter
    only = F.array(*[z[1 << k] - z[0] for k in range(len(FILTERS))])
    fair = F.array(*[_over_all_orders(z, k) for k in range(len(FILTERS))])
    steps = F.from_json(F.lit(json.dumps(_orders())), "array<struct<filter_order:string,step:int,f:int,before:int,after:int>>")
    rows = sums.select("*", alone.alias("alone"), only.alias("only"), fair.alias("fair"), F.explode(steps).alias("s"))

    def lost(of: str) -> Column:
        return F.get(F.col(of), F.col("s.before")) - F.get(F.col(of), F.col("s.after"))

    f = F.col("s.f")
    return rows.select(
        "part", "s.filter_order", "s.step", F.get("n", F.col("s.after")).alias("kept"), lost("n").alias("removed"), (F.get("alone", f) - lost("n")).alias("redundant"),
        F.get("only", f).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("fair", f).alias("shapley"),
    )
