"""Sharding by histogram sort, in DataFrame functions only.

Key: (60 bits of the text's md5, doc_id), so equal texts are neighbours. Round by round the bytes below evenly spaced candidate
boundaries are counted exactly over all rows; each splitter keeps the candidates around its target and is refined until it is within
the tolerance or the key can't be split. A group of equal texts stays in one shard unless it is larger than a share of a shard (`whole`): only then is
it cut by doc_id. Rows are exchanged once, straight to the partition of their range, and sorted there.
A null text has no bytes and is a group of its own, a null doc_id sorts first, rows that repeat text and doc_id stay together, an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import shuffle_partitions, written

_MIN = -(1 << 63)


def _bisect(splitters: list[tuple[int, int]], h: str = "h", d: str = "d", first: int = 0) -> Column:
    """Number of splitters (h, d) that are not above the row's key, as a balanced tree of comparisons."""
    if not splitters:
        return F.lit(first)
    mid = len(splitters) // 2
    sh, sd = splitters[mid]
    not_above = F.col(h) > sh
    not_above = (F.col(h) >= sh) if sd == _MIN else not_above | ((F.col(h) == sh) & (F.col(d) >= sd))
    return F.when(not_above, _bisect(splitters[mid + 1 :], h, d, first + mid + 1)).otherwise(_bisect(splitters[:mid], h, d, first))


def _refine(rows: DataFrame, at: list[dict], key: str, tolerance: float, bins: int) -> list[dict]:
    """One round: rows has (key, g, size), each target lies in an interval [lo, hi) of group g with `below` bytes before it."""
    spans = sorted({(t["g"], t["lo"], t["hi"], t["below"]) for t in at})
    per = max(8, bins // len(spans))
    wide = [-(-(hi - lo) // per) for _, lo, hi, _ in spans]
    lit = lambda xs: F.array(*[F.lit(x).cast("decimal(38,0)") for x in xs])
    k = rows.withColumn("i", _bisect([(g, lo) for g, lo, _, _ in spans], "g", "k") - 1).filter("i >= 0")
    pick = lambda xs: F.element_at(lit(xs), F.col("i") + 1)
    off = F.col("k").cast("decimal(38,0)") - pick([s[1] for s in spans])
    k = k.withColumn("off", off).filter((F.col("g") == pick([s[0] for s in spans])) & (F.col("k") < pick([s[2] for s in spans])))
    k = k.withColumn("bin", F.floor(F.col("off") / pick(wide)).cast("long"))
    got: dict[int, list] = {}
    for r in k.groupBy("i", "bin").agg(F.sum("size").alias("s")).collect():  # at most `bins` counts, whatever the rows
        got.setdefault(r["i"], []).append((r["bin"], int(r["s"])))
    for t in at:
        i = spans.index((t["g"], t["lo"], t["hi"], t["below"]))
        g, lo, hi, cum = spans[i]
        t["edge"], t["off"], t["done"] = lo, abs(t["want"] - cum), False
        for b, s in sorted(got.get(i, [])):
            left, right = lo + b * wide[i], min(hi, lo + (b + 1) * wide[i])
            if cum + s >= t["want"]:
                near = (left, abs(t["want"] - cum)) if t["want"] - cum <= cum + s - t["want"] else (right, cum + s - t["want"])
                t["edge"], t["off"] = near
                t["lo"], t["hi"], t["below"], t["inside"] = left, right, cum, s
                break
            cum += s
        t["done"] = t["off"] <= tolerance or t["hi"] - t["lo"] <= 1
    return at


def splitters(base: DataFrame, parts: int, tolerance: float, bins: int = 8192, sub: int = 1, whole: float = 0.0) -> list[tuple[int, int]]:
    """parts - 1 keys (h, d), in order, that cut the rows (h, d, size) into parts of nearly equal size. Every sub-th boundary is one of a shard: it cuts no
    group of up to `whole` bytes."""
    total = int(base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    at = [{"want": total * k / parts, "g": 0, "lo": -1, "hi": 1 << 60, "below": 0, "inside": 0, "done": False} for k in range(1, parts)]
    if not total or not at:
        return [((1 << 62), _MIN)] * len(at)
    rows = base.select(F.lit(0).cast("long").alias("g"), F.col("h").alias("k"), "size")
    while todo := [t for t in at if not t["done"]]:
        _refine(rows, todo, "h", tolerance, bins)
    out = [(t["edge"], _MIN) for t in at]
    if cut := [j for j, t in enumerate(at) if t["off"] > tolerance and t["inside"] > (tolerance if (j + 1) % sub else max(tolerance, whole))]:  # a group of equal texts is to be cut
        groups = sorted({at[j]["lo"] for j in cut})
        own = base.filter(F.col("h").isin(groups))
        ends = {r["h"]: (r["a"], r["b"]) for r in own.groupBy("h").agg(F.min("d").alias("a"), F.max("d").alias("b")).collect()}
        inner = []
        for j in cut:
            a, b = ends[at[j]["lo"]]
            inner.append({"want": at[j]["want"], "g": at[j]["lo"], "lo": a, "hi": b + 1, "below": at[j]["below"], "done": False})
        rows = own.select(F.col("h").alias("g"), F.col("d").alias("k"), "size")
        while todo := [t for t in inner if not t["done"]]:
            _refine(rows, todo, "d", tolerance, bins)
        for j, t in zip(cut, inner, strict=True):
            out[j] = (t["g"], t["edge"]) if t["off"] < at[j]["off"] else out[j]
    return sorted(out)


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.002, whole: float = 0.05) -> DataFrame:
    """Per document: doc_id, size (bytes + 8), text_crc32, shard (0 to shards - 1) and slot (its place in the shard, gapless from 0).

    Shards are key ranges whose sizes differ from the mean by at most the tolerance (a share of a shard) or, where a document or a group of equal texts at a
    boundary is larger than that, by half of it; groups of up to `whole` of a shard are in one shard. Each shard is exchanged in several sub-ranges, so its rows need no single task.
    """
    none = F.col("text").isNull()
    base = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(_MIN + 1)).alias("d"),
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.when(none, F.lit(-1)).otherwise(F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10)).cast("long").alias("h"),
        )
    )
    sub = max(1, -(-shuffle_partitions(docs.sparkSession) // shards))
    parts = shards * sub
    mean = int(base.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]) / shards
    cuts = splitters(base, parts, mean * tolerance, sub=sub, whole=mean * whole)
    keyed = base.withColumn("part", _bisect(cuts))
    counts = {r["part"]: r["count"] for r in keyed.groupBy("part").count().collect()}
    before = []
    for p in range(parts):
        before.append(0 if p % sub == 0 else before[-1] + counts.get(p - 1, 0))
    placed = keyed.repartitionById(parts, "part").sortWithinPartitions("h", "d", "text_crc32", "size")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    starts = F.array(*[F.lit(b).cast("long") for b in before])
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.floor(F.col("part") / sub).cast("int").alias("shard"),
        (F.element_at(starts, F.col("part") + 1) + row).alias("slot"),
    )
