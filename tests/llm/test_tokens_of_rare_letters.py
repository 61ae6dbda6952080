"""Token counts on random neighbours of rare code points, against the library."""

import random
import unicodedata

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from advertlake.llm import token_counts as T

CASES = ["‍\U000125be", "\U0001262b'LL", "఼̇", "᷺̇", "a\U00012475!b", "é఼́̇x", "'S'LL\U00011de0's"]


@pytest.fixture(scope="module")
def both():
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok, T.WordBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_known_cases(both):
    tok, own = both
    assert own.count(CASES) == [len(tok.encode(t, add_special_tokens=False).ids) for t in CASES]


@pytest.mark.parametrize("seed", [3])
def test_random_neighbours(both, seed):
    tok, own = both
    rng = random.Random(seed)
    marks = [chr(i) for i in range(0x300, 0x1F000) if unicodedata.combining(chr(i))]
    plain = ["'", "'s", "'LL", "a", "B", "é", "1", "!", " ", "\n", "\u0085", " ", "‍", "İ", "ı", "Σ", "ς", "ǅ", "가", "ᄀ", "ᅡ", "क", "़", "<|endoftext|>"]
    kinds = [lambda: rng.choice(plain), lambda: rng.choice(marks), lambda: chr(rng.randrange(0x80, 0x3000)), lambda: chr(rng.choice([*range(0xA000, 0xD800), *range(0xE000, 0x1F000)])), lambda: chr(rng.randrange(0x1F000, 0x110000))]
    texts = ["".join(rng.choice(kinds)() for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    got = own.count(texts)
    bad = [(t, g, n) for t, g, n in zip(texts, got, (len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)), strict=True) if g != n]
    assert not bad, [([hex(ord(c)) for c in t], g, n) for t, g, n in bad[:5]]
