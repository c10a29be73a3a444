"""Packed sequences: tokens of the library, gapless sequences, few of them."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from kindred.llm import packing as P
from kindred.llm.queries import WORD_VOCABULARY

ODD = [
    "", "Σίσυφος ΑΣ'ΣΑ", "<|endoftext|>a<|startoftext|>", "don't WE'LL é é ́x", "日本語　テスト a b\x1cq\x85z", "😀😀 12 34 ½", "İ ǅ ſ K", "!'s ''s 'S",
    "w " * 9000, "x" * 3000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_VOCABULARY)


def test_tokens_of_the_library(library):
    rng = random.Random(1)
    texts = ODD + ["".join(chr(rng.choice([rng.randint(0, 255), rng.randint(0, 0x2FFF), rng.randint(0x10000, 0x1FFFF), 32, 10])) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    with open(WORD_VOCABULARY, encoding="utf-8") as f:
        words = P.WordTokens(f.read(), cached=200)
    for at in range(0, len(texts), 100):
        for text, ids in zip(texts[at : at + 100], words.encode(texts[at : at + 100]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def check(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(sequences)


def test_documents(documents, library):
    rows = list(enumerate([*ODD, None])) + [(None, "null id"), (3, "repeated id"), (3, "repeated id")]
    got = P.pack_documents(documents(rows), WORD_VOCABULARY, 4096).collect()
    check(got, 4096)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert P.pack_documents(documents([]), WORD_VOCABULARY).collect() == []


def test_any_columns_are_carried(spark):
    df = spark.createDataFrame([(i, 300 + i % 5, "a", "b", "c", "d", "e", "f") for i in range(50)], "id long, length int, offset string, bin string, used string, _row string, item string, sequence_id string")
    got = P.pack(df, 1024, group=20, fan_in=2)
    assert sorted(got.columns) == sorted(["id", "length", "bin", "used", "_row", "item", "sequence_id", "offset"])
    rows = got.collect()
    check(rows, 1024)
    assert {r.bin + r.used + r._row + r.item for r in rows} == {"bcde"} and len(rows) == 50
    assert P.pack(df.filter("false"), 1024).collect() == []


@pytest.mark.parametrize("kind", ["mixed", "small", "large", "equal"])
def test_tree_packs_nearly_as_well_as_one_group(spark, kind):
    rng = np.random.default_rng(4)
    n, capacity = 6000, 1024
    lengths = {
        "mixed": np.minimum(capacity, rng.lognormal(5, 1, n).astype(int) + 1), "small": rng.integers(1, 20, n),
        "large": rng.integers(capacity // 2 + 1, capacity + 1, n), "equal": np.full(n, 300),
    }[kind]
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(lengths)], "i long, length long")
    got = P.pack(df, capacity, group=300, fan_in=4).collect()
    assert len(got) == n
    used = check(got, capacity)
    one = len(P.best_fit(lengths, capacity)[2])
    assert used <= one * 1.03 + 1


def test_best_fit_against_a_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(0, 60))
        bins, offsets, used = P.best_fit(lengths, 100)
        room = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                room.append(100 - n)
        assert sorted(100 - used) == sorted(room)
        for b in range(len(used)):
            mine = sorted(zip(offsets[bins == b], lengths[bins == b], strict=True))
            assert sum(x for _, x in mine) == used[b] and all(a + x == c for (a, x), (c, _) in zip(mine, mine[1:], strict=False))
