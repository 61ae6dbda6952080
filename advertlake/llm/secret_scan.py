"""Secrets in texts: three fixed patterns, and a battery of randomness tests on the other long tokens.

Base spans, leftmost and not overlapping per kind: assign (a named value of 12 or more characters), access (key ids of 18 or more), hex (16 or more);
matches that are too short are dropped. All offsets are code points, ends exclusive.

Every token of 20 or more characters of the base-64 alphabets gets the smallest alphabet that holds it (hex, base 32, base 36, base 64) and three tests
of the hypothesis that its symbols are drawn evenly from that alphabet: chi-squared of the symbol counts, the number of runs above and below the
middle, and the serial correlation of neighbours. Each is a standard deviate, and their square sum (chi-squared of 3 degrees for a random token) is the
score: low for random tokens, high for words. How often plain text scores so low depends on alphabet and length, so it is measured on the corpus: the
other characters of every document, joined and cut into pieces of LENGTHS, are decoys, scored in the same way in each alphabet. A token's p-value is the
share of decoys of its alphabet, and of the greatest length not above its own, that score no higher; the Benjamini-Hochberg rule over the tokens of
all documents that overlap no base span keeps the rate of false discoveries at `rate`. Those that pass, and whose randomness is not itself rejected,
are spans of the kind "random". Counts of decoys and tokens cover the whole corpus; the driver holds one number per alphabet, length and score step.

A null text is empty. Documents that repeat are scanned alike, each in its own row. Texts of any length are read whole, about 4 MB of text at a time or
one text if longer. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from advertlake.llm.common import written

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

#: Sizes of the alphabets: hex, base 32, base 36, base 64.
SIZES = (16, 32, 36, 64)
LENGTHS = (20, 28, 40, 64)
#: Scores come in steps; the last one holds all that is higher.
STEP, STEPS = 0.25, 120
#: 0.999 quantile of chi-squared with 3 degrees: above it a token is not random.
_RANDOM = 16.27
_BATCH_BYTES, _ROWS = 4 << 20, 1 << 14


def _alphabet(symbols: str, fold: bool) -> np.ndarray:
    """Byte -> value, 255 for none; folded alphabets take both cases of a letter."""
    out = np.full(256, 255, np.uint8)
    for v, c in enumerate(symbols):
        out[ord(c)] = v
        if fold:
            out[ord(c.swapcase())] = v
    return out


_LOWER = "0123456789abcdefghijklmnopqrstuvwxyz"
_64 = _alphabet("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/", fold=False)
_64[[ord("-"), ord("_")]] = 62, 63
VALUES = (_alphabet(_LOWER[:16], True), _alphabet(_LOWER[2:8] + _LOWER[10:], True), _alphabet(_LOWER, True), _64)
_OF_ONE_CASE = (re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[A-Z2-7]+"), re.compile(r"[0-9a-z]+|[0-9A-Z]+"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, in order."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), k, m.end()) for k, rule in ((1, _ACCESS), (2, _HEX)) for m in rule.finditer(text)]
    return sorted(out)


def alphabet_of(token: str) -> int:
    """The place in SIZES of the smallest alphabet that holds the token."""
    return next((k for k, rule in enumerate(_OF_ONE_CASE) if rule.fullmatch(token)), 3)


def battery(v: np.ndarray, size: int) -> np.ndarray:
    """The score of each row of symbol values (tokens of one length): square sum of the deviates of the three tests."""
    m, n = v.shape
    v = v.astype(np.int64)
    counts = np.bincount((np.arange(m)[:, None] * size + v).ravel(), minlength=m * size).reshape(m, size)
    even = ((counts * counts).sum(axis=1) * size / n - n - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    above = 2 * v >= size
    runs = ((above[:, 1:] != above[:, :-1]).sum(axis=1) - (n - 1) / 2) / (np.sqrt(n - 1) / 2)
    centred = 2 * v - (size - 1)
    serial = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / ((size * size - 1) / 3 * np.sqrt(n - 1))
    return even**2 + runs**2 + serial**2


def step_of(score: np.ndarray) -> np.ndarray:
    return np.minimum(score / STEP, STEPS - 1).astype(np.int64)


def code_of(alphabet: int, length: int, step: np.ndarray) -> np.ndarray:
    """One number for alphabet, greatest length of LENGTHS not above the token's, and score step."""
    return (alphabet * len(LENGTHS) + int(np.searchsorted(LENGTHS, length, side="right")) - 1) * STEPS + step


def decoys(rests: list[bytes]) -> np.ndarray:
    """How many pieces of the joined symbols of each text have each code: pieces of LENGTHS in turn, in each alphabet."""
    out = np.zeros(len(SIZES) * len(LENGTHS) * STEPS, np.int64)
    raw = np.frombuffer(b"".join(rests), np.uint8)
    owner = np.repeat(np.arange(len(rests)), [len(r) for r in rests])
    for k, size in enumerate(SIZES):
        v = VALUES[k][raw]
        used = v < 255
        v, n = v[used], np.bincount(owner[used], minlength=len(rests))
        first, offset, turn = np.cumsum(n) - n, 0, sum(LENGTHS)
        for length in LENGTHS:
            times = np.maximum(0, (n - offset - length) // turn + 1)
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            start = np.repeat(first + offset, times) + turn * inner
            for lo in range(0, len(start), _ROWS):
                score = battery(v[start[lo : lo + _ROWS, None] + np.arange(length)], size)
                out += np.bincount(code_of(k, length, step_of(score)), minlength=len(out))
            offset += length
    return out


def scan_texts(texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int, bool]]], np.ndarray]:
    """Per text its base spans and its tokens as (start, end, code, overlaps no base span); and the decoys of all."""
    base, found, rests, groups = [], [], [], {}
    for text in texts:
        own = base_spans(text)
        tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        pieces, at = [], 0
        for a, z in sorted([(a, z) for a, _, z in own] + tokens):
            pieces.append(text[at:a])
            at = max(at, z)
        pieces.append(text[at:])
        rests.append("".join(pieces).encode("ascii", "ignore"))
        free, b = [], 0
        for a, z in tokens:
            while b and own[b - 1][2] > a:
                b -= 1
            while b < len(own) and own[b][2] <= a:
                b += 1
            free.append(not any(s < z and e > a for s, _, e in own[b : b + 3]))
        for i, (a, z) in enumerate(tokens):
            groups.setdefault((alphabet_of(text[a:z]), z - a), []).append((len(base), i, text[a:z]))
        base.append(own)
        found.append([(a, z, 0, f) for (a, z), f in zip(tokens, free, strict=True)])
    for (k, n), some in groups.items():
        for lo in range(0, len(some), max(1, (_ROWS * 64) // n)):
            part = some[lo : lo + max(1, (_ROWS * 64) // n)]
            v = VALUES[k][np.frombuffer("".join(t for _, _, t in part).encode(), np.uint8)].reshape(len(part), n)
            for (d, i, _), code in zip(part, code_of(k, n, step_of(battery(v, SIZES[k]))).tolist(), strict=True):
                a, z, _, f = found[d][i]
                found[d][i] = (a, z, code, f)
    return base, found, decoys(rests)


def written_as(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def discovered(tokens: dict[int, int], plain: dict[int, int], rate: float) -> list[int]:
    """The codes that pass: counts of tokens and of decoys by code, Benjamini-Hochberg over all tokens."""
    p = {}
    for code in tokens:
        first, step = code // STEPS * STEPS, code % STEPS
        low = sum(plain.get(first + s, 0) for s in range(step + 1))
        p[code] = (1 + low) / (1 + low + sum(plain.get(first + s, 0) for s in range(step + 1, STEPS)))
    every, so_far, bound = sum(tokens.values()), 0, 0.0
    for value in sorted(set(p.values())):
        so_far += sum(n for c, n in tokens.items() if p[c] == value)
        if value * every <= rate * so_far:
            bound = value
    return sorted(c for c in tokens if p[c] <= bound and (c % STEPS) * STEP < _RANDOM)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_TOK = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("code", pa.int32()), ("free", pa.bool_())])
_HIST = pa.struct([("code", pa.int32()), ("n", pa.int64())])
_SCANNED = (
    "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:long,kind:int,end:long>>, "
    "tokens array<struct<start:long,end:long,code:int,free:boolean>>, decoys array<struct<code:int,n:long>>"
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, at = [x or "" for x in batch.column("text").to_pylist()], 0
        while at < len(texts):
            start, size = at, 0
            while at < len(texts) and (at == start or size + len(texts[at]) <= _BATCH_BYTES):
                size += len(texts[at])
                at += 1
            base, tokens, plain = scan_texts(texts[start:at])
            n = [[sum(1 for s in own if s[1] == k) for own in base] for k in range(3)]
            sha = [hashlib.sha256(written_as(own).encode()).hexdigest() for own in base]
            counts = [{"code": int(c), "n": int(plain[c])} for c in np.flatnonzero(plain)]
            columns = [
                batch.column("doc_id").slice(start, at - start), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()),
                pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in own] for own in base], pa.list_(_SPAN)),
                pa.array([[dict(zip(("start", "end", "code", "free"), s, strict=True)) for s in own] for own in tokens], pa.list_(_TOK)),
                pa.array([counts, *[None] * (at - start - 1)], pa.list_(_HIST)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens", "decoys"])


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 (of its base spans) and spans (kind:start:end of all spans, by start, then kind)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = written(docs.select("doc_id", "text").mapInArrow(_scan, _SCANNED.format(kind)))
    plain = {r["code"]: r["n"] for r in seen.select(F.explode("decoys").alias("x")).groupBy("x.code").agg(F.sum("x.n").alias("n")).collect()}
    tokens = {r["code"]: r["n"] for r in seen.select(F.explode("tokens").alias("x")).filter("x.free").groupBy("x.code").agg(F.count("*").alias("n")).collect()}
    codes = F.array(*[F.lit(c) for c in discovered(tokens, plain, rate)]).cast("array<int>")
    added = F.transform(
        F.filter("tokens", lambda t: t["free"] & F.array_contains(codes, t["code"])), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))
    )
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return seen.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.concat_ws(",", spans).alias("spans"))
