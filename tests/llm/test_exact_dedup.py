"""Block naming against a dictionary of normalised texts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kindred.llm import exact_dedup as E


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[normal(t)]
        known = [x for x in ids if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(ids), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed=1):
    random.seed(seed)
    alphabet = ["a", "b", " ", "\n", "\t ", "\u00a0", "é", "日"]
    rows = [(i, "".join(random.choices(alphabet, k=random.choice([0, 1, 3, 40, 41])))) for i in range(150)]
    long = "".join(random.choices("xyz ", k=5000))
    rows += [(200, None), (201, ""), (202, " "), (203, "\n\n"), (204, long), (205, long + "!"), (206, long.replace(" ", "  ")), (207, "z" + long)]
    return rows + [(None, "a"), (None, "only null"), (None, "only null")]


def test_against_brute_force(documents):
    rows = rows_of()
    for size in (16, 4096):
        got = [tuple(r)[:3] + (r.text_sha256,) for r in E.exact_dedup(documents(rows), size=size).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_one_of_each_group_is_kept(documents):
    rows = [*rows_of(), (3, "twice"), (3, "twice"), (1000, "twice"), (3, "other")]
    got = E.exact_dedup(documents(rows), size=16).collect()
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({normal(t) for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    docs = documents(rows)
    left = E.keep_distinct(docs, size=16)
    assert left.columns == docs.columns
    assert sorted(normal(r.text) for r in left.collect()) == sorted({normal(t) for _, t in rows})


def test_keys_that_clash_are_replaced(documents):
    def weak(block, seed):
        if seed < 2:
            return [F.lit(seed).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2")]
        return E.block_keys(block, seed)

    rows = rows_of(2)
    got = [tuple(r)[:3] + (r.text_sha256,) for r in E.exact_dedup(documents(rows), size=16, keys=weak).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_columns_of_any_name_are_carried(documents):
    docs = documents([(1, "a  b"), (2, "a b"), (3, None)]).selectExpr("*", *[f"'x' AS {c}" for c in ("_id", "_sha", "_c0", "keep_id", "text_sha256")])
    left = E.keep_distinct(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_empty_table(documents):
    assert E.exact_dedup(documents([])).collect() == []
    assert E.keep_distinct(documents([])).collect() == []


def test_block_contents_are_shuffled_after_dropping_duplicates(documents):
    docs = documents([(i, "same " * 2000) for i in range(300)])
    got = E.exact_dedup(docs).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 300)} and sum(r.kept for r in got) == 1
