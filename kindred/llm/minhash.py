"""MinHash near-deduplication with tensored banding and exact verification.

Documents are sets of word shingles; equal sets form a class, and only classes go on. Two collections of ``M`` half keys each hash
``K`` minhashes; a table key pairs one half key of either collection, so ``M * M`` tables cost ``2 * M * K`` minhashes instead
of ``2 * M * M * K``. A pair of similarity s shares a table with probability ``(1 - (1 - s^K)^M)^2``: 0.9999 at 0.85 and more above.

Half keys that only one class has are dropped first: no table key made of them can be shared. Within a bucket classes are tied to its smallest
member, never to each other; what hangs together that way is a cluster of candidates. Clusters are verified on full shingle sets in tiles of
bounded size, each pair of chunks in a task of its own, so a cluster of any size needs the memory of two chunks. A tile returns
links that join parts of it which were not joined before, at most as many as it has members. Connected components of the links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.llm.common import materialise, only_cache, text_or_empty, via_arrow
from kindred.operators.scale_out import broadcast_if_small

WORDS = 5
PERCENT = 85
M, K = 14, 4
CHUNK_ROWS = 1024
CHUNK_SHINGLES = 1 << 20
CACHED_WORDS = 100_000
BLOCK = 512


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_odd = np.random.default_rng(5)
_FACTORS = _odd.integers(0, 2**63, 2 * WORDS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _odd.integers(0, 2**31, 2 * M * K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _odd.integers(0, 2**32, 2 * M * K, dtype=np.uint32)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingles of a text as 64-bit hashes. Words are what ASCII white space separates, A-Z lower-cased; a text
    of fewer words is one shingle, one without words none."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    total = np.full(n, size, np.uint64) * _FACTORS[-1]
    for i in range(size):
        total = _mixed(total + h[i : i + n] * _FACTORS[i])
    return np.unique(total)


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """``2 * M`` half keys of every non-empty set: each hashes ``K`` minhashes."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), 2 * M), np.uint64)
    for f in range(2 * M * K):
        least = np.minimum.reduceat(flat * _A[f] + _B[f], starts).astype(np.uint64)
        side = f // K
        start = out[:, side] if f % K else np.full(len(sets), side + 1, np.uint64)
        out[:, side] = _mixed(start * _FACTORS[0] + least)
    return out


SIGNATURES = pa.schema([
    ("doc_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()),
    ("halves", pa.list_(pa.int64())),
])


def _signatures(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    only_cache("minhash", _hashes.clear)
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        sets = [shingles(t) for t in part["text"].to_pylist()]
        used = [i for i, s in enumerate(sets) if len(s)]
        halves: list[list[int]] = [[] for _ in sets]
        if used:
            for i, row in zip(used, half_keys([sets[i] for i in used]).view(np.int64).tolist(), strict=True):
                halves[i] = row
        keys = np.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], dtype="S16")
        keys = np.frombuffer(keys.tobytes().ljust(16 * len(sets), b"\0"), np.int64).reshape(-1, 2)
        columns = [[len(s) for s in sets], keys[:, 0].copy(), keys[:, 1].copy(), halves]
        given = [part[c] for c in ("doc_id", "t1", "t2")]
        yield pa.record_batch([*given, *[pa.array(c, f.type) for c, f in zip(columns, list(SIGNATURES)[3:], strict=True)]], schema=SIGNATURES)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``; equal labels for connected nodes.

    Every node hooks onto its neighbour of least rank, ranks being hashes, and edges are drawn between the hooks; what is left shrinks by a
    share each round, whatever the shape. All tables are narrow and written, hot nodes are met by joins that Spark can split.
    """
    edges = materialise(edges.filter("a <> b"), name)
    found = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("rank"), F.col(c).alias("to"))
        hooks = both.groupBy("node").agg(F.min(rank("other")).alias("least"))
        hooks = materialise(hooks.select("node", F.least("least", rank("node"))["to"].alias("to")), name)
        if found is None:
            found = hooks.withColumnRenamed("to", "label")
        else:
            moved = hooks.select(F.col("node").alias("label"), "to")
            found = materialise(found.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), name)
        to = lambda c: hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}2"))
        left = edges.join(to("a"), "a").join(to("b"), "b").filter("a2 <> b2")
        edges = materialise(left.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), name)
        if edges.isEmpty():
            return found


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _Sets:
    """Disjoint sets of small numbers."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.parent[b] = a
        return a != b


def verified_links(sets: list[np.ndarray], side: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` that join unjoined parts, with at least ``percent`` of their union in common.

    ``side`` is 0 for all, or 0 and 1 for the two chunks of a tile: then only pairs between the chunks are held against each other.
    """
    if len(sets) < 2:
        return []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(code, kind="stable")
    posting, first = owner[order], np.concatenate([[0], np.cumsum(count)])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    groups, links, across = _Sets(len(sets)), [], bool(side.any())
    for x in range(len(sets)):
        if across and side[x]:
            continue
        mine = code[starts[x] : starts[x + 1]]
        begin, n = first[mine], count[mine]
        shared = n > 1
        begin, n = begin[shared], n[shared]
        if not len(n):
            continue
        # The postings of all shingles of x, one after another.
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        inter = np.bincount(posting[at], minlength=len(sets))
        good = 100 * inter >= percent * (sizes[x] + sizes - inter)
        good[: x + 1] &= across
        if across:
            good &= side == 1
        good[x] = False
        links += [(x, int(y)) for y in np.flatnonzero(good) if groups.join(x, int(y))]
    return links


def _tiles(table: pa.Table) -> pa.Table:
    table = table.sort_by([("cluster", "ascending"), ("chunk", "ascending"), ("rep", "ascending")])
    cluster, rep = table["cluster"].to_numpy(), table["rep"].to_numpy()
    side = (table["chunk"].to_numpy() != table["p"].to_numpy()).astype(int)
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table["shingles"]]
    cuts = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1], [True]]))
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out += [(rep[a + x], rep[a + y]) for x, y in verified_links(sets[a:b], side[a:b])]
    columns = zip(*out, strict=True) if out else [[], []]
    return pa.table([pa.array(c, pa.int64()) for c in columns], schema=LINKS)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """``a, b``: every class of a shared bucket and the smallest class there."""
    half = classes.select("rep", F.posexplode("halves").alias("side", "half"))
    shared = half.groupBy("side", "half").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    kept = half.join(materialise(shared, "halves"), ["side", "half"]).groupBy("rep").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") < M, F.struct("side", "half")))).alias("left"),
        F.sort_array(F.collect_list(F.when(F.col("side") >= M, F.struct("side", "half")))).alias("right"),
    )
    keys = kept.select("rep", F.explode("left").alias("l"), "right").select("rep", "l", F.explode("right").alias("r"))
    entries = materialise(keys.select("rep", F.xxhash64("l.side", "l.half", "r.side", "r.half").alias("bucket")), "entries")
    leaders = materialise(
        entries.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").drop("last"), "leaders"
    )
    met = entries.join(leaders, "bucket").filter("rep <> leader")
    return met.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if at least 85 % of the union of their shingles are common; a component is named by its smallest id and keeps that
    document. Null and empty texts and texts without words have no shingles and are linked with nothing. Rows with a null id
    are judged by themselves: their component is null and they are kept. Repeated rows come back as often as they stand
    there, all with the same result. Other columns are not read; an empty table gives no rows.
    """
    return _judged(docs, id, text).select("doc_id", "n_shingles", "component_id", "kept")


def _text_keys(text: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), text_or_empty(text)).alias(f"t{i}") for i in (1, 2)]


def _judged(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``near_duplicates`` with ``t1, t2``, which name the text of a row."""
    signed = docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), *_text_keys(text))
    source = signed.select("doc_id", "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _signatures(batch)

    rows = materialise(signed.mapInArrow(sign, from_arrow_schema(SIGNATURES)), "signatures")
    linked = rows.filter("n > 0 and doc_id is not null")
    # A class has a number of its own, as an id may stand for several texts; the written table fixes it.
    grouped = linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    classes = materialise(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")
    links = materialise(links_of(source, classes), "links")
    named = components(links)
    ids = classes.select(F.col("rep").alias("node"), "first")
    smallest = named.join(ids, "node").groupBy("label").agg(F.min("first").alias("component_id"))
    of_rep = materialise(named.join(smallest, "label").select(F.col("node").alias("rep"), "component_id"), "groups")
    of_class = materialise(
        classes.select("k1", "k2", "rep", "first").join(of_rep, "rep", "left").select("k1", "k2", F.coalesce("component_id", "first").alias("component_id")), "named"
    )
    plain = rows.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "k1", "k2")
    joined = plain.filter("n_shingles > 0 and doc_id is not null").join(of_class, ["k1", "k2"])
    alone = plain.filter("n_shingles = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    columns = ("doc_id", "t1", "t2", "n_shingles", "component_id")
    return joined.select(*columns).unionByName(alone.select(*columns)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def links_of(source: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links ``a, b`` between classes: enough of them to connect what is linked."""
    clusters = components(candidate_edges(classes), "clusters").select(F.col("node").alias("rep"), F.col("label").alias("cluster"))
    members = materialise(clusters.join(classes.select("rep", "first", "n", "k1", "k2"), "rep"), "members")
    sizes = members.groupBy("cluster").agg(F.count("*").alias("rows"), F.sum("n").alias("total")).select(
        "cluster", F.greatest(F.ceil(F.col("rows") / CHUNK_ROWS), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int").alias("chunks"), "rows", "total"
    )
    sizes = materialise(sizes, "sizes")
    # Clusters of one chunk share bins of about a chunk.
    small = sizes.filter("chunks = 1").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).first()
    bins = max(1, -(-(small["rows"] or 0) // CHUNK_ROWS), -(-(small["total"] or 0) // CHUNK_SHINGLES))
    placed = members.join(sizes.drop("rows", "total"), "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    placed = materialise(placed.select("rep", F.col("first").alias("doc_id"), "k1", "k2", "cluster", "chunks", "chunk"), "placed")
    texts = source.join(broadcast_if_small(placed, max_rows=200_000), "doc_id")
    schema = pa.schema([
        ("rep", pa.int64()), ("cluster", pa.int64()), ("chunks", pa.int32()), ("chunk", pa.int32()), ("shingles", pa.large_binary()),
    ])

    def shingle(batch: pa.RecordBatch) -> pa.RecordBatch:
        only_cache("minhash", _hashes.clear)
        keep, sets = [], []
        for i, (text, a, b) in enumerate(zip(batch["text"], batch["k1"].to_pylist(), batch["k2"].to_pylist(), strict=True)):
            data = shingles(text.as_py()).tobytes()
            # An id may stand for several texts; only the one of this class is meant.
            if tuple(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist()) == (a, b):
                keep.append(i)
                sets.append(data)
        part = batch.take(pa.array(keep, pa.int64()))
        return pa.record_batch([*[part[c] for c in ("rep", "cluster", "chunks", "chunk")], pa.array(sets, pa.large_binary())], schema=schema)

    sets = via_arrow(texts.select("rep", "cluster", "chunks", "chunk", "text", "k1", "k2"), shingle, schema)
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    tiles = sets.withColumn("other", F.explode(others)).select(
        F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bins))).otherwise(F.col("cluster")).alias("tile"),
        F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"),
        (F.col("chunks") > 1).alias("large"), "rep", "cluster", "chunk", "shingles",
    )
    return tiles.groupBy("tile", "large", "p", "q").applyInArrow(_tiles, from_arrow_schema(LINKS))


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns, whatever their names.

    A row is judged by its id and its text: where one id stands for several texts, only those in a component with a smaller id go. Rows that repeat an id
    and a text stay or go together. Null ids, null and empty texts stay; an empty table gives no rows.
    """
    dropped = _judged(docs, id, text).filter(~F.col("kept")).select("doc_id", "t1", "t2").distinct()
    dropped = broadcast_if_small(materialise(dropped, "dropped"), max_rows=200_000)
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(*columns, F.col(id).cast("long").alias("doc_id"), *_text_keys(text))
    kept = marked.join(dropped, ["doc_id", "t1", "t2"], "left_anti")
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
