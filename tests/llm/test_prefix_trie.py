"""The conversation trie against plain dictionaries, and the radix tree against a sorted list."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from kindred.llm import prefix_trie
from kindred.llm.prefix_trie import Few, Many, RadixTree, Some, conversations_of, rebuilt, trie_nodes

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("id", "bytes", "turns", "key", "shared", "depth", "n")],
])
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], TURNS).repartition(3)


def sequences(rows):
    """The rebuilt conversations, by id."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, name, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    seqs = sequences(rows)
    members = {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        d = len(node)
        below = [m for m in members if m[:d] == node]
        children = [m for m in below if len(m) == d + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(seqs[c]) == d))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), d, parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **options):
    nodes = trie_nodes(rebuilt(conversations_of(frame(spark, rows))), **options)
    assert tuple(nodes.columns) == COLUMNS
    return sorted((tuple(r) for r in nodes.collect()), key=str)


ODD = [
    (0, 0, "user", "a"), (0, 1, None, "b"), (0, None, "system", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "", "b"),
    (2, 7, "user", "é" * 3000), (3, None, None, None), (None, 0, "user", "a"), (-3, 0, "user", "a"), (-5, 1, "user", "z"), (10, 0, "u", "sera"),
    (11, 0, "us", "era"), (12, 0, "u", "sera"), *((14, t, "user", f"turn {t}") for t in range(40)), *((15, t, "user", "same") for t in range(30)),
    *((c, t, "user", "same") for c in range(20, 40) for t in range(c % 4)), *((c, 0, "user", "only") for c in range(41, 60, 5)),
]


@pytest.mark.parametrize("range_bytes", [4 << 20, 300])
def test_odd_rows(spark, range_bytes):
    assert got(spark, ODD, range_bytes=range_bytes) == brute(ODD)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_random_conversations_in_many_ranges(spark):
    rng = random.Random(5)
    rows = [
        (c, t, rng.choice(["user", "assistant"]) if t else "user", f"text {rng.randint(0, 2) if t else 0}")
        for c in range(150) for t in range(rng.randint(0, 12))
    ]
    assert got(spark, rows, range_bytes=200) == brute(rows)


@pytest.mark.parametrize("cuts", [[], [1], [3, 4], [1, 2, 3, 4, 5, 6, 7]])
def test_ranges_sum_up_to_one(cuts):
    """Prefixes that begin, end and go on at the edges of ranges."""
    turn = [bytes([i]) * 16 for i in range(4)]
    keys = [b"", turn[0], turn[0] + turn[1], turn[0] + turn[1] + turn[0], turn[0] + turn[1] + turn[0] + turn[3], turn[0] + turn[1] + turn[2],
            turn[2], turn[2] + turn[2] + turn[2]]
    rows = [(k, [10 * (i + 1) for i in range(len(k) // 16)], 100 - at, at + 1, f"e{at}") for at, k in enumerate(keys)]

    def summed(edges):
        bounds, found = [0, *edges, len(rows)], {}
        for a, b in zip(bounds, bounds[1:]):
            out = prefix_trie.range_nodes(
                *[[r[i] for r in rows[a:b]] for i in range(5)], rows[a - 1][0] if a else None, rows[b][0] if b < len(rows) else None
            )
            for r in zip(*out.values()):
                n = dict(zip(out, r))
                key = (n["shared"], n["depth"]) if n["shared"] is not None else (n["conv_id"], n["depth"], "own")
                old = found.get(key, (10**9, 0, 0, 0, 0, None))
                sums = [x + n[c] for x, c in zip(old[1:5], ("n_convs", "n_children", "n_leaves", "saved_tokens"))]
                found[key] = (min(old[0], n["conv_id"]), *sums, old[5] or n["ends_sha256"])
        return sorted(((v[0], k[1], *v[1:]) for k, v in found.items()), key=str)

    assert summed(cuts) == summed([])


def test_radix_tree_layouts_and_compression():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(range(256 if i % 2 else 30), k=rng.randint(0, 6))) for i in range(4000)})
    tree = RadixTree()
    for row, key in rng.sample(list(enumerate(keys)), len(keys)):
        tree.insert(key, row)
    found, kinds, stack = [], set(), [(tree.root, b"")]
    while stack:
        node, at = stack.pop()
        at += node.path
        kinds.add((type(node.children).__name__, getattr(node.children, "limit", 0)))
        if node.end >= 0:
            found.append((at, node.end))
        below = node.children.each()
        assert len(below) != 1 or node.end >= 0  # a path without branches is one string
        assert [b for b, _ in below] == sorted(b for b, _ in below)
        stack += [(n, at + bytes([b])) for b, n in below]
    assert sorted(found) == [(k, i) for i, k in enumerate(keys)]
    assert kinds == {(Few.__name__, 4), (Few.__name__, 16), (Some.__name__, 0), (Many.__name__, 0)}
    assert sum(1 for _ in tree.bottom_up()) < 2 * len(keys)
