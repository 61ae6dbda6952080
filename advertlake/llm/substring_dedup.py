"""Exact substring deduplication with fixed-block anchors.

A window is `window` consecutive words of one document; words are [^\\x20\\x09-\\x0D]+. The first `block` = window / 2 words from each multiple of
block on are reference blocks: non-overlapping, and each window holds a whole one. Every rolling run of `block` words probes them. A window that
holds no run whose hash is a reference block elsewhere cannot repeat. The hits of the others are extended to the windows that cover them, and
overlapping repeats join to maximal repeated spans. Extension goes by windows and not by pairs of hits, word by word, because a passage that n
documents share has n * n pairs: the covering windows are looked up by two independent hashes (64 and 32 bits, taken from the words anew), and
the one that starts first (smaller doc_id, then earlier start) stays. A window counts as repeated only if both hashes agree.

Null and empty texts have no words. Rows that repeat a doc_id are ordered by text. Texts of any length are read whole. An empty table gives an
empty result. Columns other than doc_id and text pass through unread, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import mix, window_hashes, word_hashes, written
from advertlake.llm.exchange import batch_of, batches, freed, row_id, split_by_bucket, table_of

_SALT = np.uint64(0x5851F42D4C957F2D)


class Batch:
    """The windows of the documents of one batch, in the order of (doc_id, mark, text)."""

    def __init__(self, ids: list[int], marks: list[int], texts: list[str | None], window: int, buckets: int):
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], marks[i], texts[i] or ""))
        self.raw = [(texts[i] or "").encode() for i in self.order]
        self.window, self.block, self.buckets = window, window // 2, buckets
        self.spans, probes, aligned, wide, more, self.places = [], [], [], [], [], []
        for k, (start, end, h, other) in enumerate(word_hashes(self.raw)):
            self.spans.append((start, end))
            if len(h) < window:
                continue
            run = window_hashes(h, self.block)
            probes.append(run)
            aligned.append(np.arange(len(run)) % self.block == 0)
            wide.append(window_hashes(h, window))
            more.append((window_hashes(other, window) >> np.uint64(32)).astype(np.uint32))
            self.places.append((k, len(run), len(wide[-1])))
        none = np.zeros(0, np.uint64)
        self.probe = np.concatenate(probes) if probes else none
        self.aligned = np.concatenate(aligned) if aligned else np.zeros(0, bool)
        self.wide = np.concatenate(wide) if wide else none
        self.more = np.concatenate(more) if more else none.astype(np.uint32)

    def probe_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(bucket << 30 | 30-bit fingerprint) of the distinct probes, sorted, and for each probe its place among them."""
        key = (self.probe % np.uint64(self.buckets)) << np.uint64(30) | self.probe >> np.uint64(34)
        return np.unique(key, return_inverse=True)

    def probe_rows(self) -> Iterator[tuple[int, bytes]]:
        keys, at = self.probe_keys()
        block = np.bincount(at, weights=self.aligned, minlength=len(keys)) > 0
        more = np.bincount(at, minlength=len(keys)) > 1
        code = ((keys & np.uint64((1 << 30) - 1)) << np.uint64(2)).astype(np.uint32) | block.astype(np.uint32) | more.astype(np.uint32) << 1
        some, bounds = split_by_bucket((keys >> np.uint64(30)).astype(np.int64), self.buckets)
        for b in some:
            yield int(b), code[bounds[b] : bounds[b + 1]].tobytes()

    def candidates(self, answers: dict[int, bytes]) -> np.ndarray:
        """True for each window that holds a run whose reference block is found elsewhere."""
        keys, at = self.probe_keys()
        hit = np.zeros(len(keys), bool)
        some, bounds = split_by_bucket((keys >> np.uint64(30)).astype(np.int64), self.buckets)
        for b in some:
            if int(b) in answers:
                n = bounds[b + 1] - bounds[b]
                hit[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(answers[int(b)], np.uint8), count=n).astype(bool)
        seen = np.concatenate(([0], np.cumsum(hit[at])))
        out = np.zeros(len(self.wide), bool)
        p = w = 0
        for _, n_probe, n_wide in self.places:
            i = p + np.arange(n_wide)
            out[w : w + n_wide] = seen[i + self.window - self.block + 1] > seen[i]
            p, w = p + n_probe, w + n_wide
        return out

    def wide_keys(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows of `of`, by bucket: their two hashes, buckets, and first places in `of`; and the place of each window among them."""
        h, more = self.wide[of], self.more[of]
        order = np.lexsort((more, h))
        new = np.ones(len(of), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
        at = np.empty(len(of), np.int64)
        at[order] = np.cumsum(new) - 1
        first = order[new]
        bucket = (mix(h[first] ^ _SALT) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return h[first][order], more[first][order], bucket[order], first[order], back[at]

    def wide_rows(self, answers: dict[int, bytes]) -> Iterator[tuple[int, bytes]]:
        h, more, bucket, _, _ = self.wide_keys(np.flatnonzero(self.candidates(answers)))
        some, bounds = split_by_bucket(bucket, self.buckets)
        for b in some:
            own = slice(bounds[b], bounds[b + 1])
            yield int(b), h[own].tobytes() + more[own].tobytes()

    def repeated(self, answers: dict[int, bytes], earlier: dict[int, bytes]) -> np.ndarray:
        """True for each window whose words start earlier in another place."""
        of = np.flatnonzero(self.candidates(answers))
        h, _, bucket, first, at = self.wide_keys(of)
        known = np.zeros(len(h), bool)
        some, bounds = split_by_bucket(bucket, self.buckets)
        for b in some:
            if int(b) in earlier:
                n = bounds[b + 1] - bounds[b]
                known[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(earlier[int(b)], np.uint8), count=n).astype(bool)
        again = np.ones(len(of), bool)
        again[first] = False
        out = np.zeros(len(self.wide), bool)
        out[of] = again | known[at]
        return out

    def cut(self, repeated: np.ndarray) -> list[tuple[int, int, int, str, list[dict]]]:
        """Per document (place in the input, words, removed words, text that is left, removed spans of words)."""
        flags = {}
        w = 0
        for k, _, n_wide in self.places:
            flags[k] = repeated[w : w + n_wide]
            w += n_wide
        out = []
        for k, raw in enumerate(self.raw):
            start, end = self.spans[k]
            n = len(start)
            if k not in flags or not flags[k].any():
                out.append((self.order[k], n, 0, None, []))
                continue
            depth = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(flags[k])
            np.add.at(depth, at, 1)
            np.add.at(depth, at + self.window, -1)
            gone = np.cumsum(depth[:n]) > 0
            edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
            pieces, last = [], 0
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                pieces.append(raw[last : start[a]])
                last = start[b] if b < n else len(raw)
            pieces.append(raw[last:])
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            out.append((self.order[k], n, int(gone.sum()), b"".join(pieces).decode(), spans))
        return out


def _join_probes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the probes of a bucket, those that are a reference block and occur twice: a bit for each probe, to the batch that sent it."""
    t = table_of(rows)
    if t is None:
        return
    bucket = t["bucket"].to_numpy()
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        parts = [np.frombuffer(x, np.uint32) for x in t["data"].take(pa.array(at)).to_pylist()]
        code = np.concatenate(parts)
        fp, place = np.unique(code >> np.uint32(2), return_inverse=True)
        times = np.bincount(place, weights=1 + (code >> np.uint32(1) & np.uint32(1)), minlength=len(fp))
        block = np.bincount(place, weights=code & np.uint32(1), minlength=len(fp))
        yield _answers(b, t["g"].take(pa.array(at)), parts, ((times > 1) & (block > 0))[place])


def _join_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the windows of a bucket, those that an earlier batch has too."""
    t = table_of(rows)
    if t is None:
        return
    bucket = t["bucket"].to_numpy()
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        g = t["g"].take(pa.array(at))
        data = t["data"].take(pa.array(at)).to_pylist()
        parts = [np.frombuffer(x, np.uint64, len(x) // 12) for x in data]
        h, more = np.concatenate(parts), np.concatenate([np.frombuffer(x, np.uint32, len(x) // 12, len(x) // 12 * 8) for x in data])
        sender = np.repeat(g.to_numpy(), [len(p) for p in parts])
        order = np.lexsort((sender, more, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order[1:]] != h[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
        late = np.empty(len(h), bool)
        late[order] = sender[order] > sender[order[new]][np.cumsum(new) - 1]
        yield _answers(b, g, parts, late)


def _answers(bucket: int, g: pa.ChunkedArray, parts: list[np.ndarray], yes: np.ndarray) -> pa.RecordBatch:
    out, at = [], 0
    for who, p in zip(g.to_pylist(), parts, strict=True):
        own = yes[at : at + len(p)]
        at += len(p)
        if own.any():
            out.append((who, np.packbits(own).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in out], pa.int32()), pa.array([bucket] * len(out), pa.int32()), pa.array([x[1] for x in out], pa.binary())],
        ["g", "bucket", "data"],
    )


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    g, b, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(b, pa.int32()), pa.array(data, pa.binary())], ["g", "bucket", "data"])


_PACKED = "g int, bucket int, data binary"


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with all their columns; text without the repeated words, and n_words, n_removed, removed (spans of words [start, end)) beside it.

    A text from which nothing is removed is unchanged; cut texts keep the white space before the words that stay.
    """
    if window < 2 or window % 2:
        raise ValueError("window must be even")
    n, splits = batches(docs)
    other = [c for c in docs.columns if c != "text"]
    names = {c: f"c{i}" for i, c in enumerate(other)}
    base = docs.select(row_id().alias("id"), F.xxhash64("text").alias("mark"), F.col("text").alias("text"), *[F.col(c).alias(names[c]) for c in other])
    base = base.withColumn("g", batch_of(splits, F.col("id"), F.col("mark")))
    lean = base.select("g", "id", "mark", "text")

    def loaded(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, dict, dict]]:
        t = table_of(rows)
        if t is None:
            return
        g, kind = t["g"].to_numpy(), t["kind"].to_numpy()
        for own in np.unique(g):
            answers = [{}, {}]
            for k in (1, 2):
                a = t.take(pa.array(np.flatnonzero((g == own) & (kind == k)))).select(["bucket", "data"])
                answers[k - 1] = dict(zip(a["bucket"].to_pylist(), a["data"].to_pylist(), strict=True))
            yield int(own), t.take(pa.array(np.flatnonzero((g == own) & (kind == 0)))), *answers

    def send_probes(rows):
        for g, t, _, _ in loaded(rows):
            b = Batch(t["id"].to_pylist(), t["mark"].to_pylist(), t["text"].to_pylist(), window, n)
            yield _packed([(g, k, data) for k, data in b.probe_rows()])

    def send_windows(rows):
        for g, t, answers, _ in loaded(rows):
            b = Batch(t["id"].to_pylist(), t["mark"].to_pylist(), t["text"].to_pylist(), window, n)
            yield _packed([(g, k, data) for k, data in b.wide_rows(answers)])

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(rows):
        for _, t, answers, earlier in loaded(rows):
            texts = t["text"].to_pylist()
            b = Batch(t["id"].to_pylist(), t["mark"].to_pylist(), texts, window, n)
            got = b.cut(b.repeated(answers, earlier))
            own = t.take(pa.array([x[0] for x in got], pa.int64()))
            left = pa.array([texts[x[0]] if x[3] is None else x[3] for x in got], pa.string())
            new = [left, pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[4] for x in got], span)]
            cols = [own[names[c]].combine_chunks() for c in other]
            whole = pa.table([*cols, *new], [*[names[c] for c in other], "text", "n_words", "n_removed", "removed"])
            yield from whole.to_batches(max_chunksize=1000)

    def dealt(docs_part: DataFrame, *answers: DataFrame) -> DataFrame:
        """The documents of each batch and the answers to it, in the partition of the batch."""
        d = docs_part.withColumn("kind", F.lit(0))
        for k, a in enumerate(answers):
            d = d.unionByName(a.withColumn("kind", F.lit(k + 1)), allowMissingColumns=True)
        for c, kind in (("bucket", "int"), ("data", "binary")):
            if c not in d.columns:
                d = d.withColumn(c, F.lit(None).cast(kind))
        return d.repartitionById(n, "g")

    found = written(dealt(lean).mapInArrow(freed(send_probes), _PACKED).repartitionById(n, "bucket").mapInArrow(freed(_join_probes), _PACKED))
    before = written(
        dealt(lean, found).mapInArrow(freed(send_windows), _PACKED).repartitionById(n, "bucket").mapInArrow(freed(_join_windows), _PACKED)
    )
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{names[c]} {kinds[c]}" for c in other), "text string", "n_words long", "n_removed long", "removed array<struct<start:long,end:long>>"])
    out = dealt(base, found, before).mapInArrow(freed(cut), schema)
    keep = [F.col(names[c]).alias(c) if c != "text" else F.col("text") for c in docs.columns]
    return out.select(*keep, "n_words", "n_removed", "removed")


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space."""
    got = remove_repeats(docs.select("doc_id", "text"), window)
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(words.cast("binary"), 256).alias("kept_sha256"))
