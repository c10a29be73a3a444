"""Best-fit packing of token sequences by hierarchical residual packing.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Pieces are dealt by a hash into groups of about
``GROUP`` rows, and each group is packed by best fit, longest pieces first. Bins that are nearly full, or have room for
nothing that is left, are emitted. The underfull bins of ``FAN_IN`` groups meet as items of the next round, and so on up the tree until one group
is left. No task ever holds more than a group: if underfull bins stay too many for a smaller number of groups, the tree ends there.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from kindred.llm.bpe import byte_letters
from kindred.llm.common import bucket_of, latin, materialise, only_cache, parts_of, text_or_empty

GROUP = 20_000
FAN_IN = 8
NEARLY_FULL = 16
CACHED_WORDS = 200_000
# Bytes of text that are encoded together.
PART = 2 << 20
# Characters of the longest word that is merged here.
OWN_LENGTH = 40
END = np.array([1], "<u4").tobytes()


# Letters and digits below U+0100, and how the vocabulary splits words, digits and signs.
_LETTER, _DIGIT = "a-zA-ZªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_DIGIT}]|[^\\s{_LETTER}{_DIGIT}]+")
# Python counts these among white space, Unicode does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_UNIT = re.compile(r"[^\x20\x09-\x0D]+")
_NONE = np.iinfo(np.int32).max


class WordMerges:
    """Byte-pair merges of many words at once: words of one length are the rows of a table, and each round merges the first pair of lowest rank of every row."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str) -> None:
        letters = {b: c for c, b in byte_letters().items()}
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocabulary[letters[b] + suffix] for b in range(256)], np.int64)
        self.nothing = max(vocabulary.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocabulary[x] * self.nothing + vocabulary[y] for x, y in pairs], np.int64)
        self.merged = np.array([vocabulary[x + y] for x, y in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.rank]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where(np.maximum(left, right) < self.nothing, left * self.nothing + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _rows(self, tokens: np.ndarray) -> np.ndarray:
        """Merges the rows of ``tokens`` in place and gives their lengths; behind them stands ``nothing``."""
        size = tokens.shape[1]
        lengths, rows = np.full(len(tokens), size), np.arange(len(tokens))
        t, ranks, places = tokens, self._ranks(tokens[:, :-1], tokens[:, 1:]), np.arange(size)
        while size > 1 and len(rows):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            go = best < _NONE
            tokens[rows[~go]] = t[~go]
            t, ranks, rows, at, best = t[go], ranks[go], rows[go], at[go], best[go]
            each = np.arange(len(rows))
            after = places > at[:, None]
            t = np.where(after, np.pad(t[:, 1:], ((0, 0), (0, 1)), constant_values=self.nothing), t)
            t[each, at] = self.merged[best]
            ranks = np.where(after[:, :-1], np.pad(ranks[:, 1:], ((0, 0), (0, 1)), constant_values=_NONE), ranks)
            has = at < size - 1
            ranks[each[has], at[has]] = self._ranks(t[each[has], at[has]], t[each[has], at[has] + 1])
            has = at > 0
            ranks[each[has], at[has] - 1] = self._ranks(t[each[has], at[has] - 1], t[each[has], at[has]])
            lengths[rows] -= 1
        return lengths

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after another, and their number per word. Words are not empty and have no line feed."""
        data = np.frombuffer("\n".join(words).encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes, lengths, done = ends - starts, np.zeros(len(words), np.int64), []
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            cells = data[starts[rows][:, None] + np.arange(size)]
            tokens = self.inner[cells]
            tokens[:, -1] = self.last[cells[:, -1]]
            lengths[rows] = self._rows(tokens)
            done.append((rows, tokens))
        first = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()), "<u4")
        for rows, tokens in done:
            used = tokens < self.nothing
            ids[(first[rows][:, None] + np.arange(tokens.shape[1]))[used]] = tokens[used]
        return ids, lengths


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class WordTokens:
    """Little-endian ids of whole texts. The vocabulary drops white space, so words are encoded one by one and remembered until there are more than
    ``cached``. What lies within U+00FF is lower-cased, split and merged here; a longer word, and what stands between white space beside other letters or
    may hold special tokens, is left to the library, under a name that begins with a space."""

    def __init__(self, spec: str, cached: int = CACHED_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = json.loads(spec)["model"]
        self.merges = WordMerges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.cached = cached
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers()
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    @staticmethod
    def words(text: str) -> list[str]:
        if latin(text) and "<|" not in text and not _SEPARATORS.search(text):
            return _LATIN.findall(text.lower())
        out: list[str] = []
        for unit in _UNIT.findall(text):
            if latin(unit) and "<|" not in unit and not _SEPARATORS.search(unit):
                out += _LATIN.findall(unit.lower())
            else:
                out.append(f" {unit}")
        return out

    def _learn(self, words: list[str]) -> None:
        lengths, parts = np.zeros(len(words), np.int64), []
        own = [i for i, w in enumerate(words) if w[0] != " " and len(w) <= OWN_LENGTH]
        if own:
            ids, lengths[own] = self.merges.encode([words[i] for i in own])
            parts.append((own, ids))
        others = [i for i, w in enumerate(words) if w[0] == " " or len(w) > OWN_LENGTH]
        coded = [c.ids for c in self.tokenizer.encode_batch_fast([words[i].lstrip(" ") for i in others], add_special_tokens=False)]
        lengths[others] = [len(c) for c in coded]
        parts += [([i], np.array(c, "<u4")) for i, c in zip(others, coded, strict=True)]
        first = np.cumsum(lengths) - lengths
        found = np.zeros(int(lengths.sum()), "<u4")
        for places, ids in parts:
            found[_ragged(first[places], lengths[places])] = ids
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, found])

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        count, known = sum(map(len, split)), len(self.numbers)
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, count)
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        first = self.ends[numbers]
        lengths = self.ends[numbers + 1] - first
        ids = self.ids[_ragged(first, lengths)]
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, split)])].tolist()
        if len(self.numbers) > self.cached or len(self.ids) > 8 * self.cached:
            self._forget()
        return [ids[a:b].tobytes() for a, b in zip(upto, upto[1:])]


def _ragged(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ..`` of every stretch, one stretch after another."""
    return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


_tokens: dict[int, WordTokens] = {}


def _words_of(held) -> WordTokens:
    spec = held.value
    key = zlib.crc32(spec.encode()) << 32 | len(spec)
    only_cache("packing", _tokens.clear)
    if key not in _tokens:
        _tokens.clear()
        _tokens[key] = WordTokens(spec)
    return _tokens[key]


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of little-endian ids."""
    step = 4 * capacity
    return [
        (k, at // 4, min(step, len(ids) - at) // 4, zlib.crc32(ids[at : at + step]))
        for k, at in enumerate(range(0, len(ids), step))
    ]


def token_pieces(docs: DataFrame, path: str, capacity: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document, encoded by the tokenizer file at ``path`` and ended by id 1."""
    with open(path, encoding="utf-8") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in parts_of(batches, PART):
            coded = _words_of(held).encode(texts)
            rows = [(doc, *p) for doc, data in zip(ids, coded, strict=True) for p in pieces_of(data + END, capacity)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    source = docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return source.mapInArrow(work, from_arrow_schema(PIECES))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset per item, used per bin): longest first, each into the fullest bin it fits.

    ``lengths`` are positive and at most ``capacity``. Bins by free room are stacks; a number with one bit per amount of room
    tells the smallest that is enough.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    room: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        enough = mask >> n
        if enough:
            free = n + (enough & -enough).bit_length() - 1
            stack = room[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            b, free = len(used), capacity
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        left = free - n
        if left:
            stack = room.setdefault(left, [])
            if not stack:
                mask |= 1 << left
            stack.append(b)
    return bins, offsets, np.array(used, np.int64)


def _packed(items: DataFrame, size: str, order: list[str], groups: int, capacity: int, level: int) -> DataFrame:
    """``items`` with ``bin``, ``offset`` and ``used`` of the bin; groups of rows are packed each on its own."""
    source = items.withColumn("_group", bucket_of(order, groups))
    fields = from_arrow_schema(pa.schema([("bin", pa.int64()), ("offset", pa.int64()), ("used", pa.int64())])).fields
    schema = items.schema
    for field in fields:
        schema = schema.add(field)

    def pack(table: pa.Table) -> pa.Table:
        # The order of arrival differs between attempts of a task; the order of packing must not.
        table = table.sort_by([(c, "ascending") for c in order])
        group = table["_group"][0].as_py()
        bins, offsets, used = best_fit(table[size].to_numpy(), capacity)
        out = table.drop_columns(["_group"])
        first = (level << 56) + (group << 28)
        for name, values in (("bin", bins + first), ("offset", offsets), ("used", used[bins])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return source.groupBy("_group").applyInArrow(pack, schema)


def pack(pieces: DataFrame, capacity: int, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """``pieces`` (any columns and a positive ``length`` of at most ``capacity``) with ``sequence_id`` and ``offset``.

    Columns that have these two names already are replaced. Every row is packed, repeated ones too. An empty table gives no rows.
    """
    names = {c: f"_c{i}" for i, c in enumerate(pieces.columns) if c not in ("sequence_id", "offset")}
    columns = [F.col(n).alias(c) for c, n in names.items()]
    given = pieces.select(*[F.col(c).alias(n) for c, n in names.items()], F.monotonically_increasing_id().alias("_row"))
    stored = materialise(given, "pieces")
    n = stored.count()
    groups, level = max(1, -(-n // group)), 0
    packed = materialise(_packed(stored, names["length"], ["_row"], groups, capacity, level), "packed")
    open_ = packed.select("bin", "used").distinct()
    moves = None
    while groups > 1:
        least = open_.agg(F.min("used")).first()[0]
        open_ = materialise(open_.filter((capacity - F.col("used") > NEARLY_FULL) & (capacity - F.col("used") >= F.lit(least))), "open")
        n = open_.count()
        fewer = max(-(-groups // fan_in), -(-n // group))
        if not n or fewer >= groups:
            break
        groups, level = fewer, level + 1
        items = open_.select(F.col("bin").alias("item"), F.col("used").alias("length"))
        step = materialise(_packed(items, "length", ["item"], groups, capacity, level), "packed")
        open_ = step.select("bin", "used").distinct()
        step = step.select("item", F.col("bin").alias("to"), F.col("offset").alias("shift"))
        if moves is None:
            moves = step
        else:
            further = step.select(F.col("item").alias("to"), F.col("to").alias("to2"), F.col("shift").alias("shift2"))
            moves = moves.join(further, "to", "left").select(
                "item", F.coalesce("to2", "to").alias("to"), (F.col("shift") + F.coalesce("shift2", F.lit(0))).alias("shift")
            )
            moves = materialise(moves, "moves")
    if moves is None:
        return packed.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    return packed.join(moves, F.col("bin") == F.col("item"), "left").select(
        *columns, F.coalesce("to", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    Null and empty texts are one piece of one token, the end. Repeated rows are packed as often as they stand there, with null ids
    or not; other columns are not read. An empty table gives no rows.
    """
    return pack(token_pieces(docs, path, capacity, id, text), capacity)
