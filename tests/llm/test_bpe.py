"""The automaton against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from kindred.llm import bpe
from kindred.llm.queries import BYTE_VOCABULARY

ODD = [
    "", "a" * 50, "aaa aaa", " " * 7 + "x", "  \n\n x\t\ty  ", "don't WE'LL I'M 'sss", "<|endoftext|>hi<|endoftext|>", "日本語 テスト ١٢٣ x",
    "á b\x1cq\x85z   　x", "😀😀 = = ==== -----", "12345 ½²³ª º", "\x00\x01 \x7f", "hello\r\n\r\nworld ​ zero", "ſ K İ ǅ", "z" * 4000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(BYTE_VOCABULARY), cached=500)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    alphabet = " \n'abcdeéß日!?<|>endoftext129\t_-=."
    for k in range(n):
        if k % 2:
            yield "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60)))
        else:
            yield "".join(chr(rng.choice([rng.randint(0, 255), rng.randint(0, 0x2FFF), rng.randint(0x10000, 0x1FFFF), 32, 32])) for _ in range(rng.randint(1, 40)))


def test_against_the_library(codec, library):
    for text in [*ODD, *random_texts(4000)]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids, text
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_any_tokens(codec, library):
    rng = random.Random(1)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 20))]
        assert codec.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_what_merges_give():
    """A small vocabulary with runs: every word against plain merging in rank order."""
    merges = [("a", "a"), ("a", "b"), ("aa", "ab"), ("b", "b"), ("bb", "a"), ("aa", "aa"), ("ab", "bba"), ("c", "ab")]
    vocabulary = {c: i for i, c in enumerate("abc")}
    for u, v in merges:
        vocabulary[u + v] = len(vocabulary)
    automaton = bpe.Automaton(vocabulary, merges, {})

    def merged(word):
        parts = list(word)
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return tuple(vocabulary[p] for p in parts)

    rng = random.Random(2)
    for _ in range(5000):
        word = "".join(rng.choice("aabbc") for _ in range(rng.randint(1, 14)))
        assert automaton.encode(word.encode()) == merged(word), word


def test_bad_vocabularies_and_words():
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0, "b": 1, "ab": 2, "aba": 3}, [("ab", "a"), ("a", "b")], {})
    with pytest.raises(ValueError):
        bpe.Automaton({"a": 0}, [], {}).encode(b"ab")
    assert bpe.Automaton({}, [], {}).encode(b"") == ()


def test_tables(documents, library):
    rows = list(enumerate([*ODD, None])) + [(None, "null id"), (0, ""), (0, "")]
    got = sorted((tuple(r) for r in bpe.round_trip(documents(rows), BYTE_VOCABULARY).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    both = bpe.decode(bpe.encode(documents(rows, extra=False), BYTE_VOCABULARY), BYTE_VOCABULARY, text="again")
    assert all((r.text or "") == r.again for r in both.collect())
    assert bpe.round_trip(documents([]), BYTE_VOCABULARY).collect() == []
