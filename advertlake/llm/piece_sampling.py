"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

Text is cut before each run of spaces, as no piece has a space mark after another character. For each distinct segment of a block of texts, all
pieces at all positions form a lattice (found by walking a trie with arrays, all positions at once). Forward filtering gives ln(alpha) of each
node position by position; backward sampling draws, for all occurrences of all segments at once, the piece that ends at the current node with its
posterior probability, until the start is reached. The draws are hashes of the row key, the segment's number in the text and the step, so a
row gets the same pieces in every run, block and partition.

The vocabulary's scores are merge ranks, not probabilities: a piece weighs (rank + 2) ** -temperature. A character that is no piece, and a space
mark that stands in the text itself, becomes its UTF-8 bytes, so decoding gives the text back exactly. Null texts and empty texts have no pieces
and decode to the empty text. Rows that repeat a key and text get the same pieces. Texts of any length are encoded whole.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import mix

_MARK = "▁"
#: Characters of segments whose lattice a worker keeps.
KEPT = 400_000
_SEGMENT = re.compile(" +[^ ]*")
_ODD = 0x9E3779B97F4A7C15


class Pieces:
    """The trie, the weights and the bytes of a vocabulary file (library sentencepiece)."""

    def __init__(self, path: str, temperature: float):
        import sentencepiece

        self.path = path
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        self.weight = np.zeros(n)
        codes: dict[int, int] = {}
        nodes: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
                self.byte_id[self.bytes_of[i][0]] = i
                continue
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            self.bytes_of[i] = piece.replace(_MARK, " ").encode()
            self.weight[i] = -temperature * np.log(2 - sp.get_score(i))
            at = 0
            for c in piece.replace(_MARK, " "):
                k = codes.setdefault(ord(c), len(codes) + 1)
                if k not in nodes[at]:
                    nodes[at][k] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][k]
            ends[at] = i
        self.width = len(codes) + 1
        step = sorted((a * self.width + k, b) for a, own in enumerate(nodes) for k, b in own.items())
        self._hashed(np.array([s[0] for s in step], np.int64), np.array([s[1] for s in step], np.int64))
        self.end = np.array(ends, np.int64)
        self.code = np.zeros(0x110000, np.int32)
        self.code[list(codes)] = list(codes.values())
        self.fallback = -temperature * np.log(n)
        self.kept: dict[str, int] = {}
        self.kept_lattice: Lattice | None = None

    def _hashed(self, keys: np.ndarray, to: np.ndarray) -> None:
        """The trie's steps as a hash table with linear probing, at most a quarter full."""
        bits = int(4 * len(keys) + 1).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_to = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        slots = self._slot(keys)
        for k, t, at in zip(keys.tolist(), to.tolist(), slots.tolist(), strict=True):
            while self.slot_key[at] >= 0:
                at = (at + 1) & self.mask
            self.slot_key[at], self.slot_to[at] = k, t

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(_ODD)) >> self.shift).astype(np.int64)

    def step(self, keys: np.ndarray) -> np.ndarray:
        """The node that each step (node * width + character) leads to, -1 where there is none."""
        slot = self._slot(keys)
        held = self.slot_key[slot]
        hit = held == keys
        out = np.where(hit, self.slot_to[slot], -1)
        todo = np.flatnonzero(~hit & (held >= 0))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self.mask
            held = self.slot_key[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.slot_to[at[hit]]
            more = ~hit & (held >= 0)
            todo, at = todo[more], at[more]
        return out

    def lattice(self, segments: list[str]) -> "Lattice":
        return Lattice(self, segments)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


class Lattice:
    """All edges of the lattices of some segments. Nodes are numbered by depth and then segment (the longest first), so one sort by the end node brings
    the edges in the order of the forward pass; edges that end at node i are ptr[i] to ptr[i + 1]."""

    def __init__(self, own: Pieces, segments: list[str]):
        given = np.fromiter(map(len, segments), np.int64, len(segments))
        longest = np.argsort(-given, kind="stable")
        self.place = np.empty(len(segments), np.int64)
        self.place[longest] = np.arange(len(segments))
        size = given[longest]
        deepest = int(size[0]) if len(size) else 0
        # off[d] + place of the segment: its node at depth d
        self.off = np.concatenate(([0], np.cumsum(np.searchsorted(-size, -np.arange(deepest + 1), side="right"))))
        chars = np.frombuffer("".join([segments[i] for i in longest.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        code, stop = own.code[chars], np.repeat(np.cumsum(size), size).astype(np.int32)
        begin_of = (stop - np.repeat(size, size)).astype(np.int32)
        seg, depth = np.repeat(np.arange(len(size), dtype=np.int32), size), np.arange(len(chars), dtype=np.int32) - begin_of
        start, length, piece = [], [], []
        at, where, k = np.arange(len(chars), dtype=np.int32), np.zeros(len(chars), np.int64), 0
        single = np.zeros(len(chars), bool)
        while len(at):
            to = own.step(where * own.width + code[at + k])
            ok = to >= 0
            at, where = at[ok], to[ok]
            k += 1
            found = own.end[where]
            full = found >= 0
            start.append(at[full])
            length.append(np.full(len(start[-1]), k, np.int32))
            piece.append(found[full].astype(np.int32))
            if k == 1:
                single[start[0]] = True
            going = at + k < stop[at]
            at, where = at[going], where[going]
        bare = np.flatnonzero(~single).astype(np.int32)
        start.append(bare)
        length.append(np.ones(len(bare), np.int32))
        piece.append(-chars[bare] - 1)  # characters without a piece: their bytes
        s, n, p = np.concatenate(start), np.concatenate(length), np.concatenate(piece)
        end = (self.off[depth[s] + n] + seg[s]).astype(np.int32)
        order = np.argsort(end, kind="stable")
        s, n, self.piece, end = s[order], n[order], p[order], end[order]
        self.begin = (self.off[depth[s]] + seg[s]).astype(np.int32)
        w = own.weight[np.maximum(self.piece, 0)]
        if len(bare):
            none = np.flatnonzero(self.piece < 0)
            c = -self.piece[none] - 1
            w[none] = own.fallback * (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF).astype(np.int64))
        nodes = int(self.off[-1])
        self.ptr = np.searchsorted(end, np.arange(nodes + 1)).astype(np.int32)
        alpha, share = np.zeros(nodes), np.empty(len(w))
        for d in range(1, deepest + 1):
            a, z = self.ptr[self.off[d]], self.ptr[self.off[d + 1]]
            head = self.ptr[self.off[d] : self.off[d + 1]] - a  # every node but the first has an edge: its character
            many = np.diff(head, append=z - a)
            x = alpha[self.begin[a:z]] + w[a:z]
            m = np.maximum.reduceat(x, head)
            x = np.exp(x - np.repeat(m, many))
            total = np.add.reduceat(x, head)
            alpha[self.off[d] : self.off[d + 1]] = m + np.log(total)
            share[a:z] = x / np.repeat(total, many)
        # share of the edges of a node up to each, added up within the node, so that a draw does not depend on what else is in the lattice
        self.upto = share
        live, k = np.flatnonzero(np.diff(self.ptr) > 1), 1
        while len(live):
            e = self.ptr[live] + k
            self.upto[e] += self.upto[e - 1]
            k += 1
            live = live[self.ptr[live + 1] - self.ptr[live] > k]
        self.upto[self.ptr[self.off[1] + 1 :] - 1 if deepest else []] = 2.0
        self.size = given

    def sample(self, which: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the segments `which` with one seed each, behind each other, and their number per segment (negative piece: -char - 1)."""
        place = self.place[which]
        node, roots = self.off[self.size[which]] + place, int(self.off[1]) if len(self.off) > 1 else 0
        live = np.flatnonzero(node >= roots)
        taken, who = [], []
        step = 0
        while len(live):
            u = (mix(seed[live] + np.uint64((step * _ODD) % (1 << 64))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = self.ptr[node[live]].astype(np.int64)
            far = np.flatnonzero(self.upto[e] <= u)
            while len(far):
                e[far] += 1
                far = far[self.upto[e[far]] <= u[far]]
            taken.append(e)
            who.append(live)
            node[live] = self.begin[e]
            live = live[node[live] >= roots]
            step += 1
        if not taken:
            return np.zeros(0, np.int64), np.zeros(len(which), np.int64)
        e, w = np.concatenate(taken), np.concatenate(who)
        count = np.bincount(w, minlength=len(which))
        depth = np.repeat(np.arange(len(taken)), [len(t) for t in taken])
        out = np.empty(len(e), np.int64)
        out[np.cumsum(count)[w] - 1 - depth] = self.piece[e]
        return out, count


def _both(kept: Lattice | None, fresh: Lattice, which: np.ndarray, split: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sample() of segments of which the first `split` are those of `kept`."""
    if not split:
        return fresh.sample(which, seeds)
    n, parts = np.zeros(len(which), np.int64), []
    for lattice, at in ((kept, np.flatnonzero(which < split)), (fresh, np.flatnonzero(which >= split))):
        got, n[at] = lattice.sample(which[at] - (0 if lattice is kept else split), seeds[at])
        parts.append((at, got))
    first, out = np.cumsum(n) - n, np.empty(int(n.sum()), np.int64)
    for at, got in parts:
        own = n[at]
        out[np.repeat(first[at], own) + np.arange(len(got)) - np.repeat(np.cumsum(own) - own, own)] = got
    return out, n


class _Numbers(dict):
    """A number for each new key, in order."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_LOADED: dict[tuple[str, float], Pieces] = {}


def pieces(vocabulary: str, temperature: float = 1.0) -> Pieces:
    """The vocabulary: a path, or a name in the folder of public tokenizers. One per worker process."""
    if (vocabulary, temperature) not in _LOADED:
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _LOADED[vocabulary, temperature] = Pieces(path, temperature)
    return _LOADED[vocabulary, temperature]


def encode_block(own: Pieces, keys: list[int], texts: list[str], seed: int) -> list[np.ndarray]:
    """Sampled piece ids of each text. Segments that are frequent in the worker's first block keep their lattice; that changes the work, not the draws."""
    index, kept = _Numbers(own.kept), len(own.kept)
    which, seeds, counts = [], [], []
    for key, text in zip(keys, texts, strict=True):
        parts = _SEGMENT.findall(" " + text) if text else []
        which.append(np.fromiter(map(index.__getitem__, parts), np.int64, len(parts)))
        base = np.uint64((key * 0xD1342543DE82EF95 + seed) % (1 << 64))
        seeds.append(mix(mix(np.full(len(parts), base)) + np.arange(len(parts), dtype=np.uint64)))
        counts.append(len(parts))
    which, seeds = np.concatenate([np.zeros(0, np.int64), *which]), np.concatenate([np.zeros(0, np.uint64), *seeds])
    if not len(which):
        return [np.zeros(0, np.int32) for _ in texts]
    segments = list(index)
    if not kept:
        often = np.flatnonzero(np.bincount(which) > 1)
        often = often[np.cumsum([len(segments[i]) for i in often.tolist()]) <= KEPT] if len(often) else often
        if len(often):
            own.kept = {segments[i]: k for k, i in enumerate(often.tolist())}
            own.kept_lattice = own.lattice(list(own.kept))
    got, n = _both(own.kept_lattice if kept else None, own.lattice(segments[kept:]), which, kept, seeds)
    per_text = np.add.reduceat(np.append(n, 0), np.cumsum([0, *counts[:-1]])) * (np.array(counts) > 0)
    bare = np.flatnonzero(got < 0)
    if len(bare):  # characters as bytes
        raw = [chr(-int(c) - 1).encode() for c in got[bare]]
        times = np.ones(len(got), np.int64)
        times[bare] = [len(r) for r in raw]
        owner = np.repeat(np.repeat(np.arange(len(texts)), per_text), times)
        spot = np.cumsum(times) - times
        wide = np.repeat(got, times)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        inner = np.repeat(spot[bare], times[bare]) + np.arange(len(flat)) - np.repeat(np.cumsum(times[bare]) - times[bare], times[bare])
        wide[inner] = own.byte_id[flat]
        got, per_text = wide, np.bincount(owner, minlength=len(texts))
    return np.split(got.astype(np.int32), np.cumsum(per_text)[:-1])


def encode(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", temperature: float = 1.0, seed: int = 1, key: str = "doc_id") -> DataFrame:
    """Per document: doc_id (the key column), pieces (sampled ids), n_pieces, and lossless (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary, temperature)
        for b in batches:
            ids, texts = b.column("id"), b.column("text").to_pylist()
            keys = [zlib.crc32(b"null") if i is None else (i if isinstance(i, int) else zlib.crc32(str(i).encode())) for i in ids.to_pylist()]
            at = 0
            while at < len(texts):
                z, held = at, 0
                while z < len(texts) and (z == at or held < 1 << 20):
                    held += len(texts[z])
                    z += 1
                got = encode_block(own, keys[at:z], texts[at:z], seed)
                same = [own.decode(g.tolist()) == t for g, t in zip(got, texts[at:z], strict=True)]
                size = np.array([len(g) for g in got], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(np.concatenate(got), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, z - at), lists, pa.array(size), pa.array(same)], ["id", "pieces", "n_pieces", "lossless"])
                at = z

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, pieces array<int>, n_pieces long, lossless boolean").withColumnRenamed("id", key)


def decode(encoded: DataFrame, vocabulary: str = "piece_bpe_32k.model", key: str = "doc_id") -> DataFrame:
    """Per row of (key, pieces): the key and the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary)
        for b in batches:
            texts = [own.decode(x or []) for x in b.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("id"), "pieces").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", key)
