"""Alignment against the libraries and a plain double loop."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from kindred.llm import alignment, bpe
from kindred.llm.common import table
from kindred.llm.queries import BYTE_VOCABULARY, PIECE_MODEL

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(BYTE_VOCABULARY, encoding="utf-8") as f:
        names = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
    letters = bpe.byte_letters()
    return a, b, lambda i: bytes(letters[c] for c in names[i])


def piece_bytes(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def spans(ids, parts):
    out, at = [], 0
    for i, p in zip(ids, parts):
        out.append((at, at + len(p), i))
        at += len(p)
    return out


def brute(libraries, rows):
    a, b, a_bytes = libraries
    docs, counts = [], Counter()
    for i, text in rows:
        left = right = groups = links = []
        if text:
            ids = a.encode(f" {text}", add_special_tokens=False).ids
            parts = [a_bytes(x) for x in ids]
            other = b.encode(text)
            others = [piece_bytes(b.id_to_piece(x)) for x in other]
            if b"".join(parts) == b"".join(others) == f" {text}".encode():
                left, right = spans(ids, parts), spans(other, others)
        if left:
            shared = sorted({e for _, e, _ in left} & {e for _, e, _ in right})
            groups = [([x for s, e, x in left if lo <= s and e <= hi], [x for s, e, x in right if lo <= s and e <= hi])
                      for lo, hi in zip([0, *shared], shared)]
            links = [(x, y) for s, e, x in left for s2, e2, y in right if s < e2 and s2 < e]
            counts.update(links)
        docs.append((i, len(left), len(right), groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        listing = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        sha = hashlib.sha256(listing.encode()).hexdigest() if listing else ""
        out.append((-1 if i is None else i, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), sha))
    return sorted(out)


def got(df, **options):
    found = alignment.align(df, BYTE_VOCABULARY, PIECE_MODEL, **options)
    assert tuple(found.columns) == COLUMNS
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in found.collect())


ODD = [
    (None, None), (None, "no id"), (1, ""), (2, " "), (3, "\n"), (4, "two  words\t and\r\n lines \n\n"), (5, "<|endoftext|> <s>x</s> <0x0A> <unk>"),
    (6, "▁ is no space"), (7, "déjà vu – 東京 🙂 ﬁ é ​\x00\x01"), (7, "déjà vu – 東京 🙂 ﬁ é ​\x00\x01"), (8, "don't I'll 12345 antidisestablishmentarianism"),
    (9, "the the the the"), (9, "another text of the same id"), (10, "x" * 300), (11, "  leading and trailing  "), (12, "﻿mark   space"),
]


@pytest.mark.parametrize("options", [{}, {"piece": 3, "part": 40, "block": 100}])
def test_odd_rows(documents, libraries, options):
    assert got(documents(ODD), **options) == brute(libraries, ODD)


def test_empty_table(documents):
    assert got(documents([])) == []


def test_only_rows_without_tokens(documents):
    assert got(documents([(1, None), (2, ""), (3, "▁")])) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_very_long_text(documents, libraries):
    text = "word " * 200_000 + " " * 100_000 + "y" * 100_000
    (row,) = got(documents([(1, text)]), part=1000, block=1000)
    a, b, _ = libraries
    assert row[1:3] == (len(bpe.Codec(bpe.load(BYTE_VOCABULARY)).encode(" " + text)), len(b.encode(text)))
    assert row[4] == row[1] + row[2] - row[3]


def test_given_documents(spark, libraries):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.filter("length(text) < 1500").collect()]
    assert len(rows) > 50
    assert got(docs.filter("length(text) < 1500")) == brute(libraries, rows)


def test_groups_cover_the_text(documents, libraries):
    rows = {(r.doc_id, r.group): r for r in alignment.groups(documents([(4, ODD[5][1]), (8, ODD[10][1]), (9, None)]), BYTE_VOCABULARY, PIECE_MODEL).collect()}
    a, b, a_bytes = libraries
    for i, text in ((4, ODD[5][1]), (8, ODD[10][1])):
        data, at = f" {text}".encode(), 0
        for k in range(sum(key[0] == i for key in rows)):
            r = rows[i, k]
            assert r.start == at and data[r.start : r.end] == b"".join(map(a_bytes, r.a)) == b"".join(piece_bytes(b.id_to_piece(x)) for x in r.b)
            at = r.end
        assert at == len(data)
    assert not any(i == 9 for i, _ in rows)


def test_pieces_give_what_one_merge_gives():
    rng = random.Random(2)
    for _ in range(300):
        last = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, last + 1), rng.randint(1, last)), last})) for _ in range(2))
        want_links = {(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]}
        for size in (1, 2, 3, 7, 1000):
            i, j = alignment.diagonal_cuts(a, b, size)
            assert all(x + y == min(k * size, len(a) + len(b)) for k, (x, y) in enumerate(zip(i, j)))
            of_a, of_b, both_a, both_b = alignment.overlaps(a, b, size)
            links = list(zip(of_a.tolist(), of_b.tolist()))
            assert len(links) == len(want_links) and set(links) == want_links
            assert sorted(a[both_a]) == sorted(b[both_b]) == sorted(set(a) & set(b))
