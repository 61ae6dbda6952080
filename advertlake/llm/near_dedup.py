"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

1. Equal texts are one class member each (a document, with its number of copies); only one of them is compared.
2. Shingles are runs of five words [^\\x20\\x09-\\x0D]+ (a shorter text is one shingle). Their document frequency is counted over all documents.
   Weight: tf * (1 + IDF_SHARE * ln(N / df) / ln(N)). The idf is bounded so that a group of copies with a third of all rows, whose own shingles
   are frequent, is not torn apart by the rare words of its edits.
3. ICWS draws BANDS * ROWS samples per document; equal samples of a band make a candidate bucket. At weighted similarity 0.8 a pair shares
   at least one bucket with probability 1 - (1 - 0.8**3)**10 = 0.9992, above that with more.
4. Within a bucket, pairs are verified by their exact weighted Jaccard similarity until everything that can be linked is linked: a document is
   compared with all that are not yet in its group, so no link between groups is lost, yet a group of n near copies makes n - 1 links and not
   n * n / 2. Buckets of more than TILE documents with the same first document are dealt together into tiles that meet it and themselves; only what
   those links leave outside the largest group meets the other tiles.
5. Connected components of the links are the classes; the smallest doc_id names a class, and one row that carries it is kept.

The unit that is signed, bucketed and verified is the text, by a 64-bit hash that is checked to be unique, so any number of rows may lack a
doc_id or share one. A null doc_id comes after all others: it names a class (class_id null) only where no row of the class has an id. Two
classes can bear the same name if their rows share the id; kept is decided for each row and is true for one row of each class.

Null texts and texts without words are in no class but their own. An empty table gives an empty result. Only doc_id and text are read; other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import connected_components, mix, spread_join, window_hashes, word_hashes, written
from advertlake.llm.exchange import batch_of, batches, freed, row_id, split_by_bucket, table_of

SHINGLE, BANDS, ROWS, IDF_SHARE = 5, 10, 3, 0.25
TILE = 128
_STEP = 12  # document frequencies are kept as round(_STEP * ln(df)), a byte

_RNG = np.random.default_rng(20)
_GAMMA = _RNG.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LOG_GAMMA = np.log(_RNG.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_ODD = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FP = np.uint64((1 << 40) - 1)


def shingles(texts: list[str | None], size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct shingle hashes, sorted, and how often each occurs."""
    for _, _, h, _ in word_hashes((t or "").encode() for t in texts):
        yield np.unique(window_hashes(h, min(size, len(h))), return_counts=True) if len(h) else (h, np.zeros(0, np.int64))


def weights(tf: np.ndarray, q: np.ndarray, n_docs: int) -> np.ndarray:
    """TF-IDF weights; q: round(_STEP * ln(df)) of each shingle."""
    whole = np.log(max(n_docs, 2))
    return (tf * (1 + IDF_SHARE * np.clip(1 - q / _STEP / whole, 0, 1))).astype(np.float32)


def band_keys(h: np.ndarray, w: np.ndarray, at_once: int = 1 << 14) -> np.ndarray:
    """ICWS: for each of BANDS * ROWS functions the shingle with the least ln(a) and its level t; a key for each band. Long texts go through in slices."""
    least = np.full(len(_ODD), np.inf, np.float32)
    pick, level = np.zeros(len(_ODD), np.uint64), np.zeros(len(_ODD), np.int64)
    k = np.arange(len(_ODD))
    for lo in range(0, len(h), at_once):
        own = h[lo : lo + at_once]
        x = own[None, :] * _ODD[:, None]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        r = _GAMMA[(x >> np.uint64(48)).astype(np.uint16)]
        log_c = _LOG_GAMMA[(x >> np.uint64(32)).astype(np.uint16)]
        beta = (x >> np.uint64(16)).astype(np.uint16).astype(np.float32) * np.float32(2**-16)
        t = np.floor(np.log(w[lo : lo + at_once])[None, :] / r + beta)
        log_a = log_c - r * (t - beta + 1)
        at = np.argmin(log_a, axis=1)
        better = log_a[k, at] < least
        least = np.where(better, log_a[k, at], least)
        pick = np.where(better, own[at], pick)
        level = np.where(better, t[k, at].astype(np.int64), level)
    drawn = mix(pick + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    key = np.zeros(BANDS, np.uint64)
    for j in range(ROWS):
        key = mix(key * np.uint64(31) + drawn[j::ROWS])
    return mix(key + np.arange(BANDS, dtype=np.uint64))


class _Batch:
    """Shingles of the texts of one batch that no other batch stands for, each with the smallest doc_id that it has here."""

    def __init__(self, docs: pa.Table, copies: dict[int, int], buckets: int):
        self.nodes, self.ids, self.parts, self.tf, self.times = [], [], [], [], []
        self.buckets = buckets
        seen, own = set(), []
        for i, node, text in zip(docs["id"].to_pylist(), docs["node"].to_pylist(), docs["text"].to_pylist(), strict=True):
            if node not in seen and (m := copies.get(node, 1)):
                seen.add(node)
                own.append((i, node, m, text))
        for (i, node, m, _), (h, tf) in zip(own, shingles([x[3] for x in own]), strict=True):
            if len(h):
                self.nodes.append(node)
                self.ids.append(i)
                self.parts.append(h)
                self.tf.append(tf)
                self.times.append(m)
        all_ = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        key = (all_ % np.uint64(buckets)) << np.uint64(40) | all_ >> np.uint64(24) & _FP
        self.keys, self.at = np.unique(key, return_inverse=True)
        self.some, self.bounds = split_by_bucket((self.keys >> np.uint64(40)).astype(np.int64), buckets)

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        m = np.repeat(self.times, [len(p) for p in self.parts])
        n = np.bincount(self.at, weights=m, minlength=len(self.keys)).astype(np.uint32)
        fp = (self.keys & _FP).view(np.uint8).reshape(-1, 8)[:, :5]
        for b in self.some:
            a, z = self.bounds[b], self.bounds[b + 1]
            yield int(b), fp[a:z].tobytes(), n[a:z].tobytes() if n[a:z].max() > 1 else b""

    def levels(self, answers: dict[int, bytes]) -> list[np.ndarray]:
        """round(_STEP * ln(df)) of each document's shingles."""
        q = np.zeros(len(self.keys), np.uint8)
        for b in self.some:
            if int(b) in answers:
                q[self.bounds[b] : self.bounds[b + 1]] = np.frombuffer(answers[int(b)], np.uint8)
        stops = np.cumsum([len(p) for p in self.parts])
        return np.split(q[self.at], stops[:-1]) if len(stops) else []


def _frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counts of a bucket and answers each batch with a byte per shingle it sent, where one of them is over 1."""
    t = table_of(rows)
    if t is None:
        return
    bucket = t["bucket"].to_numpy()
    for b in np.unique(bucket):
        own = t.take(pa.array(np.flatnonzero(bucket == b)))
        fps, ns = [], []
        for fp, n in zip(own["data"].to_pylist(), own["n"].to_pylist(), strict=True):
            wide = np.zeros((len(fp) // 5, 8), np.uint8)
            wide[:, :5] = np.frombuffer(fp, np.uint8).reshape(-1, 5)
            fps.append(wide.view(np.uint64)[:, 0])
            ns.append(np.frombuffer(n, np.uint32) if n else np.ones(len(wide), np.uint32))
        keys, at = np.unique(np.concatenate(fps), return_inverse=True)
        df = np.bincount(at, weights=np.concatenate(ns), minlength=len(keys))
        q = np.minimum(255, np.round(_STEP * np.log(df))).astype(np.uint8)[at]
        out, start = [], 0
        for g, fp in zip(own["g"].to_pylist(), fps, strict=True):
            part = q[start : start + len(fp)]
            start += len(fp)
            if part.any():
                out.append((g, part.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int32()), pa.array([b] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())],
            ["g", "bucket", "data"],
        )


def _links(hs: list[np.ndarray], ws: list[np.ndarray], group: np.ndarray, left: int, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of similarity >= least that join the documents as all links would. The first `left` documents meet the others, and all meet
    all if left is their number. group: equal for documents that need not be compared; those that a link has joined are not compared again."""
    n, group = len(hs), group.copy()
    vocab, at = np.unique(np.concatenate(hs), return_inverse=True)
    w = np.concatenate(ws).astype(np.float64)
    size = np.array([len(h) for h in hs])
    start = np.cumsum(size) - size
    total = np.add.reduceat(w, start)
    row = np.zeros(len(vocab))
    out = []
    for i in range(left):
        lo = i + 1 if left == n else left
        near = np.minimum(total[lo:], total[i]) >= least * np.maximum(total[lo:], total[i]) * (1 - 1e-9)
        js = lo + np.flatnonzero(near & (group[lo:] != group[i]))
        if not len(js):
            continue
        own = slice(start[i], start[i] + size[i])
        row[at[own]] = w[own]
        pick = np.concatenate([np.arange(start[j], start[j] + size[j]) for j in js])
        both = np.add.reduceat(np.minimum(w[pick], row[at[pick]]), np.cumsum(size[js]) - size[js])
        row[at[own]] = 0
        for j in js[both >= least * (total[js] + total[i] - both) - 1e-9]:
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((i, int(j)))
    return out


def _node(salt: int) -> Column:
    """A number for each text; null for one without words."""
    blank = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    return F.when(~blank, F.xxhash64(F.lit(salt), F.col("text")))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["node"] == b["node"])


def _once(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """rows (id, node, ...) with one row for each id and node of twice, a written table."""
    if twice.isEmpty():
        return rows
    same = _same_row(rows, twice)
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["id", "node"]))


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id of its class), n_copies (documents with the same text) and kept (one row of each class)."""
    return _judged(docs, threshold)[1].select(F.col("id").alias("doc_id"), "class_id", "n_copies", "kept")


def _judged(docs: DataFrame, threshold: float) -> tuple[int, DataFrame]:
    """The salt of _node, and per row: id, node, class_id, n_copies, kept, and again: not kept, but of the same id and text as the kept row."""
    n, splits = batches(docs)

    def g(col: str) -> Column:
        where = batch_of(splits, row_id(col))
        return F.when(F.col(col).isNull(), F.pmod("node", F.lit(n)).cast("int")).otherwise(where)

    for salt in count():
        base = docs.select(F.col("doc_id").cast("long").alias("id"), _node(salt).alias("node"), F.col("text").alias("text"))
        known = written(
            base.select("id", "node", F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 15), 16, 10).cast("long").alias("mark"))
            .withColumn("row", F.monotonically_increasing_id())
        )
        head = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "row"))
        texts = written(
            known.filter("node is not null").groupBy("node").agg(head.alias("head"), F.count("*").alias("m"), (F.min("mark") < F.max("mark")).alias("mixed"))
        )
        if texts.filter("mixed").isEmpty():
            break
    n_docs = known.count()
    same = written(texts.filter("m > 1").select("node", F.col("head.id").alias("first"), "m").withColumn("to", g("first")))
    base = base.filter("node is not null").withColumn("g", g("id"))
    notes = spread_join(known.filter("node is not null").select("id", "node", "row"), same, "node").filter("m is not null").withColumn("g", g("id"))
    notes = notes.select("g", "node", F.when(F.col("g") == F.col("to"), F.col("m")).otherwise(0).alias("m"))

    def dealt(*answers: DataFrame) -> DataFrame:
        d = base.withColumn("kind", F.lit(0))
        d = d.unionByName(notes.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        for a in answers:
            d = d.unionByName(a.withColumn("kind", F.lit(2)), allowMissingColumns=True)
        return d.repartitionById(n, "g")

    def loaded(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, _Batch, dict]]:
        t = table_of(rows)
        if t is None:
            return
        gs, kind = t["g"].to_numpy(), t["kind"].to_numpy()
        for own in np.unique(gs):
            part = [t.take(pa.array(np.flatnonzero((gs == own) & (kind == k)))) for k in range(3)]
            copies = dict(zip(part[1]["node"].to_pylist(), part[1]["m"].to_pylist(), strict=True))
            answers = dict(zip(part[2]["bucket"].to_pylist(), part[2]["data"].to_pylist(), strict=True)) if "bucket" in t.column_names else {}
            yield int(own), _Batch(part[0].sort_by("id"), copies, n), answers

    def send(rows):
        for own, b, _ in loaded(rows):
            got = list(b.rows())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([own] * len(got), pa.int32()),
                    pa.array([x[0] for x in got], pa.int32()),
                    pa.array([x[1] for x in got], pa.binary()),
                    pa.array([x[2] for x in got], pa.binary()),
                ],
                ["g", "bucket", "data", "n"],
            )

    def sign(rows):
        for _, b, answers in loaded(rows):
            qs = b.levels(answers)
            bands = [band_keys(h, weights(tf, q, n_docs)) for h, tf, q in zip(b.parts, b.tf, qs, strict=True)]
            for a in range(0, len(bands), 1000):
                z = slice(a, a + 1000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b.nodes[z], pa.int64()),
                        pa.array(b.ids[z], pa.int64()),
                        pa.array([x.view(np.int64) for x in bands[z]], pa.list_(pa.int64())),
                        pa.array([q.tobytes() for q in qs[z]], pa.binary()),
                    ],
                    ["node", "id", "bands", "q"],
                )

    counts = written(
        dealt()
        .mapInArrow(freed(send), "g int, bucket int, data binary, n binary")
        .repartitionById(n, "bucket")
        .mapInArrow(freed(_frequencies), "g int, bucket int, data binary")
    )
    signed = written(dealt(counts).mapInArrow(freed(sign), "node long, id long, bands array<long>, q binary"))

    keyed = signed.select("node", F.explode("bands").alias("band"))
    buckets = keyed.groupBy("band").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"), F.min("node").alias("first")
    )
    units = buckets.filter("n > 1").groupBy("n", "who", "first").agg(F.min("band").alias("band"))
    twice = written(known.filter("node is not null").groupBy("id", "node").count().filter("count > 1").select("id", "node"))
    links = verified_links(_once(base.select("id", "node", "text"), twice), signed, written(keyed.join(units, "band").select("node", "band", "n", "first")), n_docs, threshold)
    group = connected_components(links)
    linked = texts.select("node", "head").join(group, "node")
    named = linked.groupBy("component").agg(F.min("head").alias("best"))
    best = spread_join(group, named, "component").select("node", "best")
    marked = texts.join(best, "node", "left").filter("m > 1 or best is not null").select("node", "m", F.coalesce("best", "head").alias("best"))
    out = spread_join(known.select("id", "node", "row"), marked, "node")
    alone = F.col("best").isNull()
    kept = alone | (F.col("row") == F.col("best.row"))
    return salt, out.select(
        "id",
        "node",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        F.coalesce("m", F.lit(1)).alias("n_copies"),
        F.coalesce(kept, F.lit(True)).alias("kept"),
        F.coalesce(~kept & F.col("id").eqNullSafe(F.col("best.id")) & (F.col("node") == F.col("best.node")), F.lit(False)).alias("again"),
    )


def verified_links(texts: DataFrame, signed: DataFrame, members: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """(a, b): the links that join the members (node, band, n, first) of each bucket as all its pairs of similarity >= threshold would. A signed
    text is taken from a row of its node and id."""
    large = members.filter(F.col("n") > TILE)
    # a unit is a small bucket, or one tile of all large buckets with the same first member, which meets every tile: near copies share most of
    # their buckets, so a document is in few units and not in one for each band. Such a unit bears the first member as its band.
    joint = written(large.select("first", "node").distinct())
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles).cast("int")
    lead = F.col("node") == F.col("first")
    place = F.explode(F.when(lead, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(tile)))
    dealt = joint.join(F.broadcast(joint.groupBy("first").agg(F.count("*").alias("n"))), "first").select("node", "first", lead.alias("lead"), place.alias("tile"))
    unit = dealt.select("node", F.col("first").alias("band"), F.lit(True).alias("part"), "lead", F.xxhash64(F.lit("first"), "first", "tile").alias("unit"))
    small = members.filter(F.col("n") <= TILE).select("node", "band", F.lit(False).alias("part"), F.lit(False).alias("lead"), F.xxhash64("band", F.lit(0)).alias("unit"))
    unit = unit.unionByName(small).withColumn("side", F.lit(0))
    payload = _payload(texts, signed, members)
    got = written(_verify(unit, payload, n_docs, threshold))
    links = got.filter("b is not null").select("a", "b")
    if got.filter("b is null").isEmpty():
        return links
    # what those links have joined needs no more comparisons: of large buckets with the same first member, together, only the members outside their
    # largest group are left, and a pair that shares several of these buckets meets once
    groups = connected_components(links)
    at = written(joint.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    most = at.groupBy("first", "component").agg(F.count("*").alias("m")).groupBy("first").agg(F.max(F.struct("m", "component"))["component"].alias("most"))
    rest = written(at.join(F.broadcast(most), "first").filter("component <> most").select("node", F.col("first").alias("band")))
    if rest.isEmpty():
        return links
    # chunks of what is left meet each other once, and every tile of the largest group
    sizes = at.groupBy("first").agg(F.count("*").alias("n")).withColumnRenamed("first", "band").join(rest.groupBy("band").agg(F.count("*").alias("left")), "band")
    sizes = sizes.select("band", F.ceil(F.col("left") / TILE).cast("int").alias("chunks"), F.ceil((F.col("n") - F.col("left")) / TILE).cast("int").alias("tiles"))
    wide = joint.withColumnRenamed("first", "band").join(F.broadcast(written(sizes)), "band")
    ask = wide.join(rest, ["node", "band"], "left_semi").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int"))
    other = ask.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    place = F.xxhash64(F.lit("chunks"), "band", F.least("chunk", "other"), F.greatest("chunk", "other"))
    other = other.select("node", "band", place.alias("unit"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    met = ask.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("side", F.lit(0))
    meet = wide.join(rest, ["node", "band"], "left_anti").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    meet = meet.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("side", F.lit(1))
    both = other.unionByName(met.unionByName(meet).select("node", "band", F.xxhash64("band", "chunk", "tile").alias("unit"), "side"))
    unit = both.select("node", "band", F.lit(False).alias("part"), F.lit(False).alias("lead"), "unit", "side")
    return links.unionByName(_verify(unit, _payload(texts, signed, wide), n_docs, threshold).select("a", "b"))


def _payload(texts: DataFrame, signed: DataFrame, members: DataFrame, small: int = 1_000_000) -> DataFrame:
    """(node, text, q) of the members. Only their texts are shuffled while their numbers (8 bytes each) are few enough to broadcast, by count."""
    nodes = written(members.select("node").distinct())
    if nodes.count() <= small:
        nodes = F.broadcast(nodes)
        texts = texts.join(nodes, "node", "left_semi")
    own = signed.select("node", "id", "q").join(nodes, "node", "left_semi")
    return own.join(texts, _same_row(own, texts)).select(own["node"], "text", "q")


def _verify(unit: DataFrame, payload: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """(a, b, band): the links of each unit (node, band, part, lead, unit, side). Side 0 meets side 1, or itself where there is no side 1. Of a unit
    that is part of a bucket, also (a, null, band) for each document that is not in the group of its lead."""
    dealt = unit.join(payload, "node").repartition("unit").sortWithinPartitions("unit", "side", "node")

    def verify(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[dict]) -> list[tuple[int, int | None, int]]:
            own = [x for k, x in enumerate(held) if not k or (x["side"], x["node"]) != (held[k - 1]["side"], held[k - 1]["node"])]
            left = sum(x["side"] == 0 for x in own)
            if len(own) < 2 or not left:
                return []
            hs, ws = [], []
            for x, (h, tf) in zip(own, shingles([x["text"] for x in own]), strict=True):
                hs.append(h)
                ws.append(weights(tf, np.frombuffer(x["q"], np.uint8), n_docs))
            node, band = [x["node"] for x in own], own[0]["band"]
            links = _links(hs, ws, np.unique(node, return_inverse=True)[1], left, threshold)
            out = [(node[i], node[j], band) for i, j in links]
            if own[0]["part"]:
                root = np.arange(len(own))
                for i, j in links:
                    root[root == root[j]] = root[i]
                first = [x["lead"] for x in own].index(True)
                out += [(node[k], None, band) for k in np.flatnonzero(root != root[first])]
            return out

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], ["a", "b", "band"])

        held: list[dict] = []
        for batch in rows:
            out = []
            for x in batch.to_pylist():
                if held and x["unit"] != held[0]["unit"]:
                    out += done(held)
                    held = []
                held.append(x)
            yield packed(out)
        if held:
            yield packed(done(held))

    return dealt.select("unit", "side", "node", "band", "part", "lead", "text", "q").mapInArrow(freed(verify), "a long, b long, band long")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents, with all their columns, without those whose class another document stands for."""
    salt, judged = _judged(docs, threshold)
    dropped = written(judged.filter(~F.col("kept")).select("id", "node", "again").distinct())
    gone, again = dropped.filter(~F.col("again")), dropped.filter("again")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), _node(salt).alias("node"), F.struct("*").alias("doc"))
    rows = rows.join(gone, _same_row(rows, gone), "left_anti")
    return _once(rows, again.select("id", "node")).select("doc.*")
