"""The trie of conversation prefixes, built by adaptive radix trees over fixed-width turn ids.

A turn is named by the first 16 bytes of the SHA-256 of its role and text, a big-endian number, and a conversation by the bytes of
its turns one after another. The distinct names are sorted over all tasks; each task builds an adaptive radix tree of its range: nodes
have layouts for 4, 16, 48 or 256 children that grow when full, and a path without branches is kept as one string. Branches may fall inside a
turn; only byte depths that are whole turns are nodes of the result.

Subtree figures are summed inside the task. Prefixes that a range shares with the ranges beside it, known from their first and last names,
give partial sums, and the first range with a prefix is the one that counts it; these few are summed over all tasks. So a first turn of a
third of all conversations is spread over many ranges. Equal conversations are one name with a count; the hash of their ids is
made from sorted runs of ids, one after another, in bounded memory.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.llm.common import materialise, text_or_empty
from kindred.operators.scale_out import broadcast_if_small

WIDTH = 16
# Bytes of names that one tree holds; a name counts OVERHEAD bytes more.
RANGE, OVERHEAD = 4 << 20, 64
# Ids hashed at once.
CHUNK = 2000


class Few:
    """Up to 4 or 16 children, sorted by byte."""

    def __init__(self, limit: int, keys: bytes = b"", nodes: tuple = ()) -> None:
        self.limit, self.keys, self.nodes = limit, bytearray(keys), list(nodes)

    def get(self, byte: int) -> Node | None:
        at = self.keys.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node: Node) -> Few | Some:
        if len(self.keys) == self.limit:
            return (Few(16, self.keys, self.nodes) if self.limit < 16 else Some(self.each())).put(byte, node)
        at = bisect_left(self.keys, byte)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def replace(self, byte: int, node: Node) -> None:
        self.nodes[self.keys.index(byte)] = node

    def each(self) -> list[tuple[int, Node]]:
        return list(zip(self.keys, self.nodes))


class Some:
    """Up to 48 children: a byte leads to a slot."""

    def __init__(self, items: list) -> None:
        self.slots, self.nodes = bytearray(256), []
        for byte, node in items:
            self.put(byte, node)

    def get(self, byte: int) -> Node | None:
        at = self.slots[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node: Node) -> Some | Many:
        if len(self.nodes) == 48:
            return Many(self.each()).put(byte, node)
        self.nodes.append(node)
        self.slots[byte] = len(self.nodes)
        return self

    def replace(self, byte: int, node: Node) -> None:
        self.nodes[self.slots[byte] - 1] = node

    def each(self) -> list[tuple[int, Node]]:
        return [(b, self.nodes[at - 1]) for b, at in enumerate(self.slots) if at]


class Many:
    """A place for every byte."""

    def __init__(self, items: list) -> None:
        self.nodes: list = [None] * 256
        for byte, node in items:
            self.nodes[byte] = node

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> Many:
        self.nodes[byte] = node
        return self

    def replace(self, byte: int, node: Node) -> None:
        self.nodes[byte] = node

    def each(self) -> list[tuple[int, Node]]:
        return [(b, n) for b, n in enumerate(self.nodes) if n is not None]


class Node:
    """``path`` are the bytes passed without a branch, ``end`` is the row of the name that ends behind them, or -1."""

    __slots__ = ("path", "end", "children")

    def __init__(self, path: bytes, end: int) -> None:
        self.path, self.end, self.children = path, end, Few(4)


def shared_length(a: bytes, b: bytes) -> int:
    """How many bytes two strings have in common at their start."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class RadixTree:
    """Distinct byte strings, each with a row number."""

    def __init__(self) -> None:
        self.root = Node(b"", -1)

    def insert(self, key: bytes, row: int) -> None:
        node, above, at = self.root, None, 0
        while True:
            same = shared_length(node.path, key[at : at + len(node.path)])
            if same < len(node.path):
                upper, byte = Node(node.path[:same], -1), node.path[same]
                node.path = node.path[same + 1 :]
                upper.children = upper.children.put(byte, node)
                if above is None:
                    self.root = upper
                else:
                    above.children.replace(key[at - 1], upper)
                node = upper
            at += same
            if at == len(key):
                node.end = row
                return
            below = node.children.get(key[at])
            if below is None:
                node.children = node.children.put(key[at], Node(key[at + 1 :], row))
                return
            above, node, at = node, below, at + 1

    def bottom_up(self) -> Iterator[tuple[Node, int, int, int]]:
        """Every node after its children: the node, the byte depths of its parent (-1 above the root) and its own, and its number of children."""
        stack = [(self.root, -1, len(self.root.path), False)]
        while stack:
            node, top, depth, seen = stack.pop()
            below = node.children.each()
            if seen or not below:
                yield node, top, depth, len(below)
                continue
            stack.append((node, top, depth, True))
            stack += [(n, depth, depth + 1 + len(n.path), False) for _, n in reversed(below)]


NODES = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("shared", pa.binary()), ("parent", pa.binary()),
])


def prefix_names(key: bytes, turns: int) -> list[bytes]:
    """Names of the first 0 to ``turns`` turns of ``key``."""
    names = [b""]
    for d in range(turns):
        names.append(hashlib.blake2b(names[-1] + key[d * WIDTH : (d + 1) * WIDTH], digest_size=16).digest())
    return names


def range_nodes(
    keys: list[bytes], lengths: list[list[int]], convs: list[int], counts: list[int], ends: list[str], before: bytes | None, after: bytes | None
) -> dict[str, list]:
    """The trie nodes of one sorted range of distinct names, between the names ``before`` and ``after`` it.

    ``lengths`` are the bytes of every turn's text, ``convs`` the smallest members, ``counts`` the numbers of members. Nodes that
    neighbours have too, the root among them, carry their name in ``shared`` and sums over this range; nodes below one name it in ``parent``.
    """
    tree, last = RadixTree(), len(keys) - 1
    for row, key in enumerate(keys):
        tree.insert(key, row)
    earlier = shared_length(before, keys[0]) // WIDTH if before is not None else -1
    later = shared_length(after, keys[last]) // WIDTH if after is not None else -1
    first_names, last_names = prefix_names(keys[0], max(earlier, 0)), prefix_names(keys[last], max(later, 0))
    out: dict[str, list] = {f.name: [] for f in NODES}
    # Of finished subtrees: first and last row, members, smallest member, saved bytes, leaves, counted and all topmost nodes.
    done: list[tuple] = []
    for node, top, depth, below in tree.bottom_up():
        parts = done[len(done) - below :]
        del done[len(done) - below :]
        if node.end >= 0:
            parts.append((node.end, node.end, counts[node.end], convs[node.end], 0, 0, 0, []))
        low, high = min(p[0] for p in parts), max(p[1] for p in parts)
        n, least = sum(p[2] for p in parts), min(p[3] for p in parts)
        saved, leaves, counted = (sum(p[k] for p in parts) for k in (4, 5, 6))
        tops = [t for p in parts for t in p[7]]
        turn, ending = depth // WIDTH, node.end if depth % WIDTH == 0 else -1
        while turn * WIDTH > top:
            in_earlier, in_later = low == 0 and turn <= earlier, high == last and turn <= later
            if turn:
                saved += (n - (not in_earlier)) * lengths[low][turn - 1]
            leaves += not tops and not in_later
            name = first_names[turn] if in_earlier else last_names[turn] if in_later else None if turn else b""
            at = len(out["depth"])
            row = (least, turn, None, n, counted, leaves, saved, ends[ending] if ending >= 0 else None, name, None)
            for column, value in zip(out.values(), row, strict=True):
                column.append(value)
            for t in tops:
                if name is None:
                    out["parent_conv_id"][t] = least
                else:
                    out["parent"][t] = name
            tops, counted, ending, turn = [at], int(not in_earlier), -1, turn - 1
        done.append((low, high, n, least, saved, leaves, counted, tops))
    return out


def _ids_hash(members: DataFrame) -> DataFrame:
    """``name, ends_sha256``: the hash of all ids of a name in rising order, joined by commas."""
    runs = pa.schema([("name", pa.string()), ("first", pa.int64()), ("ids", pa.string())])
    hashes = pa.schema([("name", pa.string()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, ids, out, at = batch["name"].to_pylist(), batch["conv_id"].to_pylist(), [], 0
            while at < len(names):
                end = at + 1
                while end < len(names) and names[end] == names[at] and end - at < CHUNK:
                    end += 1
                out.append((names[at], ids[at], ",".join(map(str, ids[at:end]))))
                at = end
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), runs)] if out else [[]] * 3, schema=runs)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done = []
            for k, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k == name:
                    state.update(b",")
                else:
                    if name is not None:
                        done.append((name, state.hexdigest()))
                    name, state = k, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], schema=hashes)
        if name is not None:
            yield pa.record_batch([pa.array([name]), pa.array([state.hexdigest()])], schema=hashes)

    ordered = members.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    joined = ordered.mapInArrow(join, from_arrow_schema(runs))
    return joined.repartition("name").sortWithinPartitions("name", "first").mapInArrow(digest, from_arrow_schema(hashes))


def trie_nodes(sequences: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """One row per distinct prefix of ``sequences`` (``conv_id``, unique, and ``turns``, an array of the turn's ``id`` in 32 hexadecimal digits
    and its ``bytes``).

    ``conv_id`` is the smallest member, ``depth`` the number of turns, ``parent_conv_id`` that of the prefix one turn shorter (null for the root);
    ``n_convs`` counts members, ``n_children`` the prefixes one turn longer, ``n_leaves`` those without children in the subtree, ``saved_tokens``
    sums (members - 1) times the bytes of the last turn over the subtree, and ``ends_sha256`` is the hash of the members that end here. No rows, no root.
    """
    ids = F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), ""))
    named = sequences.select("conv_id", ids.alias("key"), F.col("turns.bytes").alias("lengths"))
    named = materialise(named.withColumn("name", F.sha2("key", 256)), "sequences")
    groups = named.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    hashed = _ids_hash(named.select("name", "conv_id"))
    distinct = materialise(groups.join(hashed, "name").join(named.drop("name"), "conv_id").drop("name"), "distinct")
    size = distinct.agg(F.sum(F.octet_length("key") + OVERHEAD)).first()[0] or 0
    ranges = max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    cut = materialise(distinct.repartitionByRange(ranges, "key").withColumn("_range", F.spark_partition_id()), "ranges")
    edges = materialise(cut.groupBy("_range").agg(F.min("key").alias("first"), F.max("key").alias("last")), "edges")
    # Only the numbers of the ranges, one per 4 MB of names, pass the window; the names of the edges meet by number.
    order = Window.orderBy("_range")
    beside = edges.select("_range", F.lag("_range").over(order).alias("_before"), F.lead("_range").over(order).alias("_after"))
    lasts = edges.select(F.col("_range").alias("_before"), F.col("last").alias("before"))
    firsts = edges.select(F.col("_range").alias("_after"), F.col("first").alias("after"))
    beside = beside.join(lasts, "_before", "left").join(firsts, "_after", "left").select("_range", "before", "after")

    def build(rows: pa.Table, sides: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["key"]))
        columns = [rows[c].to_pylist() for c in ("key", "lengths", "conv_id", "n", "ends_sha256")]
        return pa.table(range_nodes(*columns, sides["before"][0].as_py(), sides["after"][0].as_py()), schema=NODES)

    nodes = cut.groupBy("_range").cogroup(beside.groupBy("_range")).applyInArrow(build, from_arrow_schema(NODES))
    nodes = materialise(nodes, "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.filter("shared is not null").groupBy("shared", "depth").agg(
        F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("parent").alias("parent"),
    ).withColumn("parent_conv_id", F.lit(None).cast("long"))
    merged = materialise(merged.select(*NODES.names), "shared")
    names = merged.select(F.col("shared").alias("_name"), (F.col("depth") + 1).alias("_depth"), F.col("conv_id").alias("_conv"))
    whole = nodes.filter("shared is null").unionByName(merged)
    found = whole.join(broadcast_if_small(names), (F.col("parent") == F.col("_name")) & (F.col("depth") == F.col("_depth")), "left")
    return found.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` of the rows ``conv_id, turn, role, text``, in order of ``turn``, null first.

    A null role or text is empty. Rows of one conversation with equal ``turn`` are ordered by the hash of role and text; repeated rows
    are turns of their own. Rows without a ``conv_id`` belong to no conversation and are left out. Other columns are not read.
    A conversation is one record: it has to fit a task, at 48 bytes a turn.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    name = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.substring(name, 1, 2 * WIDTH).alias("id"), F.octet_length(text).cast("long").alias("bytes")).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, longest: int = 8) -> DataFrame:
    """Every conversation ``c`` as the first h turns of conversation ``c - c % family`` (none if absent), and its own turns after its first h, with
    h = crc32 of the decimal ``c`` modulo ``longest + 1``. Rows are ``conv_id, turns``, one for each ``conv_id``."""
    own = materialise(conversations, "conversations")
    c = F.col("conv_id")
    heads = own.filter(c % family == 0).select(c.alias("_base"), F.slice("turns", 1, longest).alias("_head"))
    h = (F.crc32(c.cast("string")) % (longest + 1)).cast("int")
    none = F.array().cast(own.schema["turns"].dataType)
    turns = F.concat(
        F.slice(F.coalesce("_head", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    )
    return own.join(heads, c - c % family == F.col("_base"), "left").select("conv_id", turns.alias("turns"))
