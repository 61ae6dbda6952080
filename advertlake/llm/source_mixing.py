"""Mixing sources to target weights, in DataFrame functions only.

Rows with a null text have size 0, a null source is a source of its own (last in order), rows that repeat a doc_id and text draw the same
number of copies, other rows of one doc_id (or of none) draw by their texts, an empty table gives an empty result. Only doc_id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import ranked, written

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, mark: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of md5(seed:doc_id:mark), mark being the text's md5: the same in each run, on each partition and in other engines."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), mark)
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def marked(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """Per source of sizes (source, size): source_size, target and rate = target / source_size.

    The sources, by code point with null last, have the weights in turn and share `share` of all sizes by weight. No target is above
    `cap` times its source's size; what is above goes to the others by weight, until none is above. The level (target per weight)
    rises from round to round, and a source is at its cap if weight * level is above it, so the driver holds one number per round.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = ranked(per, F.col("source").asc_nulls_last(), name="rank")
    cycle = F.array(*[F.lit(w) for w in weights])
    per = written(
        per.withColumns(
            {"weight": F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")), "most": F.col("source_size") * cap}
        )
    )
    all_, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = share * all_ / weight if weight else 0.0
    while weight:
        above = F.col("weight") * F.lit(level) > F.col("most")
        capped, free = per.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if not free or (share * all_ - capped) / free <= level:
            break
        level = (share * all_ - capped) / free
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(level)))
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0)
    return written(per.select("source", "source_size", target.alias("target"), rate.alias("rate")))


def _with_copies(rows: DataFrame, rates: DataFrame, doc_id: str, mark: Column, source: str, seed: str) -> DataFrame:
    """rows with _size, _target and _copies = floor(rate), and one more with the probability that is left. Spark broadcasts the rates only while their files are under its threshold."""
    r = rates.select(
        F.col("source").alias("_source"), F.col("source_size").alias("_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate")
    )
    j = rows.join(r, rows[source].eqNullSafe(r["_source"]))
    more = (draw(F.col(doc_id), mark, seed) < F.col("_rate") - F.floor("_rate")).cast("long")
    return j.withColumn("_copies", F.floor("_rate") + more).drop("_source", "_rate")


def mixing_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, size (words), source_size, target (its source's), copies, and taken = size * copies."""
    sizes = written(docs.select(F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"), marked(F.col("text")).alias("mark")))
    got = _with_copies(sizes, source_rates(sizes, weights, share, cap), "doc_id", F.col("mark"), "source", seed)
    return got.select(
        "doc_id",
        "size",
        F.col("_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("size") * F.col("_copies")).alias("taken"),
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus: the rows of docs, with all their columns, each as often as the mix takes it."""
    sizes = written(docs.select("source", words(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")))
    cols = [F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    got = _with_copies(docs.select(*cols), source_rates(sizes, weights, share, cap), at["doc_id"], marked(F.col(at["text"])), at["source"], seed)
    got = got.filter("_copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return got.select(*[F.col(at[c]).alias(c) for c in docs.columns])
