"""Near duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np

from kindred.llm import minhash as M


def sets_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: sets_of(t) for i, t in rows if i is not None}
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            inter = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * inter >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    out = [(i, len(sets_of(t)), label.get(i), i is None or label[i] == i) for i, t in rows]
    return sorted(out, key=str)


def family(rng, base_words, n, edits):
    out = []
    for _ in range(n):
        words = list(base_words)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def rows_of(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for n, edits, length in ((30, 4, 120), (20, 2, 60), (25, 8, 300), (6, 1, 12)):
        texts += family(rng, [word() for _ in range(length)], n, edits)
    shared = " ".join(word() for _ in range(40))
    texts += [f"{shared} {' '.join(word() for _ in range(60))}" for _ in range(20)]
    texts += ["", " \n", "one two", "One  TWO", "one two three four five", "É é", "é é", "a b c d", "a b c d", None]
    texts += [t.upper() for t in texts[:3]] + [texts[0].replace(" ", "\n\t")]
    return list(enumerate(texts))


def test_against_all_pairs(documents, monkeypatch):
    rows = rows_of()
    for chunk in (1024, 7):  # the second deals every cluster to many tiles
        monkeypatch.setattr(M, "CHUNK_ROWS", chunk)
        got = sorted((tuple(r) for r in M.near_duplicates(documents(rows)).collect()), key=str)
        assert got == brute(rows)


def test_null_ids_repeated_rows_and_empty_tables(documents):
    rows = [(None, "a b c d e f"), (None, None), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, "x")]
    got = sorted((tuple(r) for r in M.near_duplicates(documents(rows)).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (9, 1, 9, True)], key=str)
    assert M.near_duplicates(documents([])).collect() == []
    left = M.keep_one(documents(rows))
    assert left.columns == documents(rows).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["2", "9", "None", "None"]


def test_a_clean_row_of_a_dropped_id_stays(documents):
    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    docs = documents([(1, a), (5, a + " end"), (5, b), (6, b + " end")]).selectExpr("*", "'x' AS _dropped", "'x' AS t1", "'x' AS _c0", "'x' AS component_id")
    left = M.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (5, b)]


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    chain = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1002), (1002, 1000)]
    found = M.components(spark.createDataFrame(chain, "a long, b long")).collect()
    labels = {r.node: r.label for r in found}
    assert len(found) == n + 3 and len({labels[i] for i in range(n)}) == 1 and len(set(labels.values())) == 2
    assert M.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_tiles_return_a_forest():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64))
    sets = [base[rng.random(len(base)) > 0.02] for _ in range(50)]
    assert len(M.verified_links(sets, np.zeros(50, int))) == 49
    side = np.array([0] * 20 + [1] * 30)
    assert all(side[a] != side[b] for a, b in M.verified_links(sets, side))


def test_a_very_long_text_and_a_hot_group(documents):
    rng = random.Random(5)
    long = " ".join(str(rng.randrange(50_000)) for _ in range(60_000))
    rows = [(i, "the same words in all of these texts, one after another") for i in range(400)] + [(900, long), (901, long + " end")]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(documents(rows)).collect()}
    assert {got[i] for i in range(400)} == {0} and got[900] == got[901] == 900
