"""Token counts of a word-level BPE vocabulary by rank-synchronous array merging.

Texts are cut at white space; each distinct word is counted once per worker and batch. The pre-tokens of all new words lie behind each other in
one ragged array of symbol ids. Every round looks up the rank of each adjacent pair, finds the lowest rank of each sequence, and merges that
pair wherever it occurs in its sequence, for all sequences at once; sequences without a known pair leave the array, and what is left of them
are their tokens. A symbol that several pairs can make may open a pair of lower rank than the one just merged: such a merge is applied at its
leftmost place only, and the rest waits for the next round, as in a strict order of (rank, place). A null or empty text has 0 tokens; texts of any
length are counted whole.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NONE = np.int64(1) << 40
#: White space of Unicode; str.split() also splits at 0x1C to 0x1F.
_BLANK = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
_OTHER = regex.compile(r"[\x1c-\x1f]")
#: Lower case of letters that Unicode 16 and 17 added; Python's own table is older.
_NEWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
_NEWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
#: Ranges that the regex library takes for letters or numbers and the tokenizer library does not, its tables being older.
_LATER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F 11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
)
#: Marks that the tokenizer library's normalisation does not reorder, as it does not know their classes.
_UNORDERED = (
    "07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 "
    "11070 1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 "
    "1E2AE 1E2EC-1E2EF 1E4EC-1E4EF"
)
_LATER, _UNORDERED = (regex.compile("([" + "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in ranges.split()) + "])") for ranges in (_LATER, _UNORDERED))


def composed(text: str) -> str:
    """NFC as the tokenizer library has it: marks of an unknown class stand like letters and part what is around them."""
    if text.isascii():
        return text
    if not _UNORDERED.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", p) for p in _UNORDERED.split(text))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Counts tokens for one vocabulary file (library tokenizers, BPE with word ends)."""

    def __init__(self, path: str, memory: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        names = byte_symbols()
        self.plain = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + end] for c in names], np.int64)
        self.size = max(vocab.values()) + 1
        keys, made = [], []
        for left, right in model["merges"]:
            keys.append(vocab[left] * self.size + vocab[right])
            made.append(vocab[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ranks, self.made = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(made, np.int64)[order]
        used = np.full(self.size, _NONE)  # the lowest rank of a pair that a symbol is part of
        for side in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(used, side, self.ranks)
        self.single = used[self.made] < self.ranks
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        special = [regex.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(sorted(special, key=len, reverse=True)))
        self.marks = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, int] = {}
        self.memory = memory

    def merge_counts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; sequence i is symbols[starts[i]:starts[i + 1]]."""
        out = np.diff(starts, append=len(symbols))
        who = np.repeat(np.arange(len(starts)), out)
        while len(symbols) > 1:
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (who[:-1] == who[1:]), self.ranks[at], _NONE)
            first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
            low = np.minimum.reduceat(np.append(rank, _NONE), first)
            size = np.diff(first, append=len(symbols))
            here = np.append(rank, _NONE) == np.repeat(low, size)
            here &= np.repeat(low < _NONE, size)
            pos = np.flatnonzero(here)
            if not len(pos):
                break
            twice = np.flatnonzero(np.diff(pos) == 1)
            if len(twice):  # a run of overlapping pairs: every other one, from the left
                run = np.concatenate(([0], np.cumsum(np.diff(pos) != 1)))
                head = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
                pos = pos[(np.arange(len(pos)) - head[run]) % 2 == 0]
            if (once := self.single[at[pos]]).any():
                pos = pos[~once | np.concatenate(([True], np.diff(who[pos]) != 0))]
            symbols[pos] = self.made[at[pos]]
            out -= np.bincount(who[pos], minlength=len(out))
            stay = np.repeat(low < _NONE, size)
            stay[pos + 1] = False
            symbols, who = symbols[stay], who[stay]
        return out

    def pretokens(self, word: str) -> tuple[list[bytes], int]:
        """The pre-tokens of a word without white space, and the number of special tokens in it."""
        if word.isascii() and word.isalpha():
            return [word.lower().encode()], 0
        parts, special = [word], 0
        if any(m in word for m in self.marks):
            special = len(self.special.findall(word))
            parts = self.special.split(word)
        got: list[bytes] = []
        for p in parts:
            p = composed(p).replace("Σ", "σ").lower()
            if not p.isascii():
                p = p.translate(_NEWER)
                if _LATER.search(p):
                    got += [p[m.start() : m.end()].encode() for m in self.pattern.finditer(_LATER.sub("\ue000", p))]
                    continue
            got += [x.encode() for x in self.pattern.findall(p)]
        return got, special

    def learn(self, new: list[str]) -> None:
        """Adds the counts of new words to those known."""
        seen: dict[bytes, int] = {}
        owner, which, base = [], [], []
        for i, w in enumerate(new):
            got, special = self.pretokens(w)
            base.append(special)
            for g in got:
                owner.append(i)
                which.append(seen.setdefault(g, len(seen)))
        total = np.array(base, np.int64)
        if seen:
            raw = np.frombuffer(b"".join(seen), np.uint8)
            size = np.fromiter(map(len, seen), np.int64, len(seen))
            stop = np.cumsum(size)
            symbols = self.plain[raw]
            symbols[stop - 1] = self.last[raw[stop - 1]]
            n = self.merge_counts(symbols, stop - size)
            total += np.bincount(owner, weights=n[which], minlength=len(new)).astype(np.int64)
        self.known.update(zip(new, total.tolist(), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(texts):
            words, held = [], 0
            while at < len(texts) and (not words or held < 1 << 21):
                t = texts[at] or ""
                words.append(_BLANK.split(t) if _OTHER.search(t) else t.split())
                held += len(t)
                at += 1
            fresh = set().union(*words).difference(self.known)
            if len(self.known) + len(fresh) > self.memory:
                self.known.clear()
                fresh = set().union(*words)
            if fresh:
                self.learn(list(fresh))
            out += [sum(map(self.known.__getitem__, w)) for w in words]
        return out


_LOADED: dict[str, WordBpe] = {}


def counter(vocabulary: str) -> WordBpe:
    """The counter of a vocabulary file: a path, or a name in the folder of public tokenizers. One per worker process."""
    if vocabulary not in _LOADED:
        path = vocabulary
        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _LOADED[vocabulary] = WordBpe(path)
    return _LOADED[vocabulary]


def n_tokens(text: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(vocabulary)
        for texts in batches:
            yield pd.Series(own.count(texts.tolist()), dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens)."""
    got = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens(F.col("text"), vocabulary).alias("n_tokens")
    )
    return got.withColumn("over_limit", F.col("n_tokens") > limit)
