"""Alignment of two tokenizations of the same texts by merge-path partitioning.

Where tokens end, as byte offsets, is a sorted list per tokenizer. Merging both lists cuts the bytes into stretches, each under one token
of either side: the overlaps. A merge of any length is divided without being made: binary searches along equidistant
diagonals find how many ends of either list come before, so each piece has the same number of ends and is merged on its
own. A piece emits its overlaps and the ends that both sides share; where a shared end falls on the border of two pieces, the stitching
notices it, takes the overlap that the second piece emitted twice away, and closes the group.

Tasks encode and align texts and write blocks: the figures of some ten thousand documents, their links as numbers of id pairs, and the block's
distinct pairs with counts. Pairs are counted over the corpus by a shuffle of one row per block and pair, and the counts
go back to the blocks that hold the pair, so what moves grows with the distinct pairs of blocks, not with links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.llm import bpe
from kindred.llm.common import materialise, only_cache, parts_of, text_or_empty

# Ends that one piece of a merge holds.
PIECE = 1 << 14
# Bytes of text that are encoded and aligned together, and those of a block.
PART, BLOCK = 1 << 20, 24 << 20
CACHED_WORDS = 100_000


def diagonal_cuts(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of ``a`` and of ``b`` come before every ``size``-th place of their merge, equal ones of ``a`` first; with both ends."""
    total = len(a) + len(b)
    at = np.arange(size, total, size)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = np.zeros(len(at), bool)
        first[open_] = a[middle[open_]] <= b[(at - middle - 1)[open_]]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    i = np.concatenate([[0], low, [len(a)]])
    return i, np.concatenate([[0], at, [total]]) - i


def merged_piece(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of one piece of two lists of ends, as places of ``a`` and ``b``, and the places of ends that both have."""
    b_at = np.searchsorted(b, a)
    a_at = np.searchsorted(a, b)
    both = np.flatnonzero(b_at < len(b))
    both = both[b[b_at[both]] == a[both]]
    alone = np.ones(len(b), bool)
    alone[b_at[both]] = False
    of_b = np.flatnonzero(alone)
    return np.concatenate([np.arange(len(a)), a_at[of_b]]), np.concatenate([b_at, of_b]), both, b_at[both]


def overlaps(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All overlaps of the tokens that end at ``a`` and ``b`` (rising, with one last end), and the shared ends, as places of both."""
    i, j = diagonal_cuts(a, b, size)
    found = []
    for k in range(len(i) - 1):
        of_a, of_b, both_a, both_b = merged_piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]])
        of_a, of_b, both_a, both_b = of_a + i[k], of_b + j[k], both_a + i[k], both_b + j[k]
        # Equal ends on a border: ``a`` has it last in the piece before, ``b`` first in this one.
        if 0 < i[k] and j[k] < j[k + 1] and a[i[k] - 1] == b[j[k]]:
            again = of_b == j[k]
            again[: i[k + 1] - i[k]] = False
            of_a, of_b = of_a[~again], of_b[~again]
            both_a, both_b = np.append(both_a, i[k] - 1), np.append(both_b, j[k])
        found.append((of_a, of_b, both_a, both_b))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(column) for column in zip(*found))


def bits_of(entries: int) -> int:
    return max(entries - 1, 1).bit_length()


class Coders:
    """Both tokenizers, and the bytes of their entries."""

    def __init__(self, automaton: bpe.Automaton, model: bytes) -> None:
        from sentencepiece import SentencePieceProcessor

        self.codec = bpe.Codec(automaton, CACHED_WORDS)
        self.a_bytes = automaton.labels
        self.pieces = SentencePieceProcessor(model_proto=model)
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_lengths, self.b_lengths = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.b_bits = bits_of(len(self.b_bytes))
        self.bits = self.b_bits + bits_of(len(self.a_bytes))
        # Ids with the sign that follows them in a listing of groups.
        self.listed = [
            f"{i}{sign}" for side, signs in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for sign in signs for i in range(len(side))
        ]

    def encode(self, texts: Sequence[str]) -> list[tuple[list[int], list[int]]]:
        """The ids of both sides; none where the bytes of one side are not those of a space and the text."""
        out = []
        for text, b in zip(texts, self.pieces.encode(list(texts), num_threads=1), strict=True):
            a = self.codec.encode(f" {text}") if text else []
            data = f" {text}".encode()
            same = b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])
            out.append((a, b) if text and same else ([], []))
        return out


class Aligned:
    """Some encoded texts, aligned as one merge: texts that follow each other share an end between them."""

    def __init__(self, coders: Coders, coded: list[tuple[list[int], list[int]]], piece: int = PIECE) -> None:
        self.coders = coders
        self.n_a, self.n_b = (np.array([len(c[side]) for c in coded], np.int64) for side in (0, 1))
        self.a, self.b = (np.array([i for c in coded for i in c[side]], np.int64) for side in (0, 1))
        ends_a, ends_b = np.cumsum(coders.a_lengths[self.a]), np.cumsum(coders.b_lengths[self.b])
        self.of_a, self.of_b, both_a, both_b = overlaps(ends_a, ends_b, piece)
        self.closes_a, self.closes_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        self.closes_a[both_a], self.closes_b[both_b] = True, True
        self.doc_a = np.repeat(np.arange(len(coded)), self.n_a)
        self.n_groups = np.bincount(self.doc_a[self.closes_a], minlength=len(coded))
        self.n_links = self.n_a + self.n_b - self.n_groups

    def linked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair of ids, number of links) of every text and pair, sorted."""
        bits = self.coders.bits
        pairs = (self.a[self.of_a] << self.coders.b_bits) | self.b[self.of_b]
        keys, counts = np.unique((self.doc_a[self.of_a] << bits) | pairs, return_counts=True)
        return keys >> bits, keys & ((1 << bits) - 1), counts

    def listings(self) -> list[str]:
        """Every text's groups as ``a1,a2|b1;a3|b2,b3``."""
        group_a, group_b = (np.cumsum(closes) - closes for closes in (self.closes_a, self.closes_b))
        size = int(self.closes_a.sum())
        before_b = np.cumsum(np.bincount(group_b, minlength=size)) - np.bincount(group_b, minlength=size)
        upto_a = np.cumsum(np.bincount(group_a, minlength=size))
        order = np.zeros(len(self.a) + len(self.b), np.int64)
        n_a, n_b = len(self.coders.a_bytes), len(self.coders.b_bytes)
        order[np.arange(len(self.a)) + before_b[group_a]] = self.a + n_a * self.closes_a
        order[np.arange(len(self.b)) + upto_a[group_b]] = self.b + n_b * self.closes_b + 2 * n_a
        listed = self.coders.listed
        signs = [listed[i] for i in order.tolist()]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(signs[s:e])[:-1] for s, e in zip([0, *ends], ends)]


_coders: dict[tuple, Coders] = {}


def _coders_of(held) -> Coders:
    automaton, model, key = held.value
    only_cache("alignment", _coders.clear)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coders(automaton, model)
    return _coders[key]


def _held(df: DataFrame, byte_path: str, piece_path: str):
    automaton = bpe.load(byte_path)
    automaton.special = {}  # their strings are ordinary text here
    with open(piece_path, "rb") as f:
        model = f.read()
    with open(byte_path, "rb") as f:
        key = (hashlib.sha256(f.read()).hexdigest(), hashlib.sha256(model).hexdigest())
    return df.sparkSession.sparkContext.broadcast((automaton, model, key))


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in FIGURES],
    ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("n_linked", pa.list_(pa.int64())), ("linked", pa.binary()), ("times", pa.binary()),
])


def packed(values: np.ndarray) -> bytes:
    """Differences of numbers below 2 ** 31 as compressed bytes."""
    return pa.compress(np.diff(values, prepend=0).astype("<i4").tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True) if n else b"", "<i4"), dtype=np.int64)


class Block:
    """What a task gathers before it writes a row."""

    def __init__(self) -> None:
        self.ids: list = []
        self.shas: list[str] = []
        self.figures: list[np.ndarray] = []
        self.linked: list[tuple] = []
        self.held = 0

    def add(self, ids: list, texts: list[str], aligned: Aligned) -> None:
        at, pairs, counts = aligned.linked()
        self.linked.append((np.bincount(at, minlength=len(ids)), pairs, counts))
        self.figures.append(np.stack([getattr(aligned, c) for c in FIGURES]))
        self.ids += ids
        self.shas += [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in aligned.listings()]
        self.held += sum(map(len, texts))

    def row(self, number: int) -> pa.RecordBatch:
        n_linked, pairs, counts = (np.concatenate(c) for c in zip(*self.linked))
        figures = np.concatenate(self.figures, axis=1)
        distinct, place = np.unique(pairs, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts)
        values = [number, self.ids, *figures, self.shas, distinct, total, n_linked, packed(place), packed(counts)]
        return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, BLOCKS, strict=True)], schema=BLOCKS)


RESULT = pa.schema([
    ("doc_id", pa.int64()), *[(c, pa.int64()) for c in FIGURES], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string()),
])


def align(
    docs: DataFrame, byte_path: str, piece_path: str, id: str = "doc_id", text: str = "text", piece: int = PIECE, part: int = PART, block: int = BLOCK
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A is the byte-level BPE file at ``byte_path`` over a space and the text, B the piece model at ``piece_path``, which adds the space itself.
    Texts that are null or empty, or that one side does not give back byte for byte, have no tokens: zeros and ''. Every row counts, repeated
    ones too, with null ids or not; other columns are not read. A text is one record, however long. An empty table gives no rows.
    """
    held = _held(docs, byte_path, piece_path)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, gathered = TaskContext.get().partitionId() << 32, Block()
        for ids, texts in parts_of(batches, part):
            coders = _coders_of(held)
            gathered.add(ids, texts, Aligned(coders, coders.encode(texts), piece))
            if gathered.held >= block:
                yield gathered.row(number)
                number, gathered = number + 1, Block()
        if gathered.ids:
            yield gathered.row(number)

    written = materialise(_texts(docs, id, text).mapInArrow(blocks, from_arrow_schema(BLOCKS)), "blocks")
    of_blocks = written.select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counted = materialise(of_blocks.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n")), "pairs")
    # At most one row for each entry of B's vocabulary.
    of_b = F.col("pair").bitwiseAND(F.lit((1 << bits_of(_pieces_in(piece_path))) - 1))
    highest = counted.groupBy(of_b.alias("_b")).agg(F.max("n").alias("_most"))
    judged = counted.join(F.broadcast(highest), of_b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))
    wanted = of_blocks.select(F.col("block").alias("of_block"), F.col("p.pairs").alias("pair")).join(judged, "pair")

    def sums(row: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(counts["pair"].to_numpy(), kind="stable")
        n = counts["n"].to_numpy()[order]
        best = counts["best"].to_numpy()[order]
        cells = {c: row[c].combine_chunks()[0] for c in row.column_names}
        n_linked = cells["n_linked"].values.to_numpy()
        size = int(n_linked.sum())
        place, times = unpacked(cells["linked"].as_py(), size), unpacked(cells["times"].as_py(), size)
        upto = np.concatenate([[0], np.cumsum(n_linked)])
        figures = []
        for of_pair in (best, n):
            running = np.concatenate([[0], np.cumsum(of_pair[place] * times, dtype=np.int64)])
            figures.append(running[upto[1:]] - running[upto[:-1]])
        columns = [cells["doc_id"].values, *[cells[c].values for c in FIGURES], *figures, cells["groups_sha256"].values]
        return pa.table([pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)

    rows = written.drop("pairs", "counts")
    return rows.groupBy("block").cogroup(wanted.groupBy("of_block")).applyInArrow(sums, from_arrow_schema(RESULT))


def _pieces_in(path: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path).get_piece_size()


GROUPS = pa.schema([
    ("doc_id", pa.int64()), ("group", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())),
])


def groups(docs: DataFrame, byte_path: str, piece_path: str, id: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """The aligned groups themselves: ``doc_id, group, start, end, a, b`` with byte offsets in a space and the text, and the ids of both sides.

    Rows without tokens give none; see ``align``.
    """
    held = _held(docs, byte_path, piece_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in parts_of(batches, part):
            coders = _coders_of(held)
            for i, listing in zip(ids, Aligned(coders, coders.encode(texts)).listings(), strict=True):
                if not listing:
                    continue
                sides = [[[int(x) for x in side.split(",")] for side in g.split("|")] for g in listing.split(";")]
                ends = np.cumsum([coders.a_lengths[a].sum() for a, _ in sides])
                columns = [[i] * len(sides), range(len(sides)), [0, *ends[:-1]], ends, [a for a, _ in sides], [b for _, b in sides]]
                yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, GROUPS, strict=True)], schema=GROUPS)

    return _texts(docs, id, text).mapInArrow(work, from_arrow_schema(GROUPS))
