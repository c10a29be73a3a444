"""Line deduplication against a plain loop, and the runs of its index."""

import random
import re

import pytest

from kindred.llm import line_dedup
from kindred.llm.line_dedup import LineRuns, dedup_lines

LONG = "the quick brown fox jumps over the lazy dog again"


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))


def brute(rows, min_length=40, min_docs=5):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key_of(line), set()).add(i)
    out = []
    for i, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            known = holders[key_of(line)] - {None}
            if len(key_of(line)) < min_length or len(known) < min_docs or i == max(known):
                kept.append(line)
        out.append((-1 if i is None else i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def got(df, **options):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in dedup_lines(df, **options).collect())


ODD = [
    (None, f"{LONG}\nx"), (None, None), (1, None), (2, ""), (3, "\n"), (4, f"  {LONG.upper()}\t\n{LONG}"), (5, f"{LONG}\r"),
    (6, LONG), (6, LONG), (7, f"{LONG}\n{LONG}\nend"), (8, f"\x0b{LONG}\x0c"), (8, f"another text of the same id\n{LONG}"),
    (9, "É" * 40), (10, "É" * 40), (11, "é" * 40), (12, "É" * 40), (13, "É" * 40), (14, "É" * 40 + "\n" + "y" * 39),
    *((i, "y" * 39 + "\n" + "\x85" + "z" * 39) for i in range(20, 27)), (30, "a\n" * 20_000 + LONG), (31, f"{LONG}x\n" * 3000),
]


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (3, 2), (7, 3)])
def test_odd_rows(documents, batches, fan_in):
    assert got(documents(ODD), batches=batches, fan_in=fan_in) == brute(ODD)


def test_random_documents(documents):
    rng = random.Random(7)
    pool = [f"line {k} " + "w" * rng.randint(20, 60) for k in range(30)]
    rows = [(rng.randint(0, 80), "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for _ in range(120)]
    assert got(documents(rows), min_docs=3) == brute(rows, min_docs=3)


def test_hot_line_is_joined_apart(documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 2)  # more than 1,000 documents and half of all lines
    rows = [(i, f"{LONG}\nown line {i} " + "v" * 40 if i % 4 else LONG) for i in range(1200)]
    assert got(documents(rows)) == brute(rows)


def test_empty_table(documents):
    assert got(documents([])) == []


def test_no_python_on_the_main_path(documents):
    plan = dedup_lines(documents(ODD[:8]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_are_compacted_and_hold_keys_once(spark):
    index, seen = LineRuns(spark, buckets=4, fan_in=2), {}
    rng = random.Random(3)
    for batch in range(5):
        rows = {(1000 - 100 * batch - rng.randint(0, 99), rng.randint(0, 20), 0) for _ in range(60)}
        index.add(spark.createDataFrame(list(rows), "doc_id long, k1 long, k2 long"))
        for key in {r[1] for r in rows}:
            docs = {r[0] for r in rows if r[1] == key}
            n, holder = seen.get(key, (0, max(docs)))
            seen[key] = (n + len(docs), holder)
        assert len(index.runs()) == bin(batch + 1).count("1")  # as a binary counter
    assert {r.k1: (r.n_docs, r.holder) for r in index.merged().collect()} == seen
    index.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kindred_run")]
