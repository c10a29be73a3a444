"""Byte-pair encoding by a tokenization automaton, and decoding by the labels of its arcs.

The automaton reads tokens and accepts exactly the token sequences that the merges produce. It starts as one state
with a loop for every byte. Each merge (u, v) -> w, in order, applies one gadget: ``w`` leads where ``v`` leads at that moment,
and the arcs of ``u`` are turned to a copy of their target that lacks the arc ``v`` (for u = v it lacks ``w`` as well, since runs merge
from the left). Thus all arcs with one label share their target, and a gadget adds one state: its parent state less one arc.

An arc ``x`` that is missing in a state is missing with everything that later merges build on its left side. With tokens
numbered in the order of the tree of left parts, younger children first, that is one interval of numbers; a state is its parent
plus one forbidden interval, and the whole automaton is five integer arrays. Rows of arcs are laid out as bits when first used.

A pre-split word is encoded by walking automaton and trie of arc labels together, longest label first. Every prefix of a word has one
accepted path, so a position that failed once needs no second visit: work is linear in the word for a bounded label length.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import latin, only_cache, text_or_empty, via_arrow

CACHED_WORDS = 200_000
CACHED_LENGTH = 64


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Compiled merges: ``target`` and ``order`` per token, ``parent``, ``low`` and ``high`` per state, ``labels`` per token."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int]) -> None:
        letters = byte_letters()
        size = max([*vocabulary.values(), *special.values()], default=-1) + 1
        self.labels = [b""] * size
        for token, i in vocabulary.items():
            self.labels[i] = bytes(letters[c] for c in token)
        self.special = dict(special)
        for token, i in special.items():
            self.labels[i] = token.encode()
        target = np.zeros(size, np.int32)
        parent, removed = [-1], [(-1, -1)]
        children: dict[int, list[tuple[int, int]]] = {}
        made = {vocabulary[c] for c in letters if c in vocabulary}
        roots = sorted(made)
        for rank, (a, b) in enumerate(merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if u not in made or v not in made or w in made:
                raise ValueError(f"merge {rank} is out of order")
            made.add(w)
            target[w] = target[v]
            parent.append(int(target[u]))
            removed.append((v, rank))
            target[u] = len(parent) - 1
            children.setdefault(u, []).append((rank, w))
        self.target, self.parent = target, np.array(parent, np.int32)
        self.order, last = np.zeros(size, np.int32), np.zeros(size, np.int32)
        at, stack = 0, [(r, False) for r in reversed(roots)]
        while stack:
            token, closing = stack.pop()
            if closing:
                last[token] = at - 1
                continue
            self.order[token] = at
            at += 1
            # Popped in the order of falling rank, so younger children come first.
            stack += [(token, True), *((w, False) for _, w in children.get(token, ()))]
        self.width = at
        self.low, self.high = np.zeros(len(parent), np.int32), np.full(len(parent), -1, np.int32)
        for state, (v, rank) in enumerate(removed[1:], 1):
            older = children.get(v, [])
            k = bisect_left(older, (rank, -1))
            self.low[state] = self.order[v]
            self.high[state] = self.order[older[k - 1][1]] - 1 if k else last[v]
        self.merged = sorted(made)
        self._prepare()

    def _prepare(self) -> None:
        self._rows: dict[int, bytes] = {}
        self.trie: dict = {}
        for token in self.merged:
            node = self.trie
            for byte in self.labels[token]:
                node = node.setdefault(byte, {})
            node[-1] = (token, int(self.order[token]), int(self.target[token]))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_rows", "trie")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def row(self, state: int) -> bytes:
        """The forbidden arcs of a state, a bit per token."""
        found = self._rows.get(state)
        if found is None:
            bits, s = np.zeros(self.width, bool), state
            while s > 0:
                bits[self.low[s] : self.high[s] + 1] = True
                s = int(self.parent[s])
            found = self._rows[state] = np.packbits(bits, bitorder="little").tobytes()
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        """The tokens of one pre-split word."""
        n, rows, root = len(word), self._rows, self.trie
        dead, path = set(), []
        at, state, options = 0, 0, None
        while at < n:
            if options is None:  # the labels that fit here, shortest first
                options, node, end = [], root, at
                while end < n:
                    node = node.get(word[end])
                    if node is None:
                        break
                    end += 1
                    arc = node.get(-1)
                    if arc is not None:
                        options.append((end, arc))
            row = rows.get(state) or self.row(state)
            while options:
                end, arc = options.pop()
                order = arc[1]
                if not row[order >> 3] >> (order & 7) & 1 and end not in dead:
                    path.append((arc[0], at, state, options))
                    at, state, options = end, arc[2], None
                    break
            else:
                dead.add(at)
                if not path:
                    raise ValueError("a byte has no token")
                _, at, state, options = path.pop()
        return tuple([step[0] for step in path])


def load(path: str) -> Automaton:
    """Compile a byte-level BPE file of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError("not a plain byte-level BPE file")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return Automaton(model["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


# White space as Unicode defines it, and the letters and digits below U+0100.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
# Cuts where the pre-splitting rule always cuts: before white space that a word follows.
_UNIT = re.compile(f"[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]+")
_LATIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


class Codec:
    """Encodes and decodes whole texts. Tokens of frequent words are remembered, for two generations of ``cached`` words."""

    def __init__(self, automaton: Automaton, cached: int = CACHED_WORDS) -> None:
        self.automaton, self.cached = automaton, cached
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        found = "|".join(re.escape(s) for s in sorted(automaton.special, key=len, reverse=True))
        self.special = re.compile(f"({found})") if found else None
        self.numerals = [str(i) for i in range(len(automaton.labels))]
        self._split: Callable | None = None

    def words(self, text: str) -> list[str]:
        """Pre-splitting. Texts beyond U+00FF are cut before white space, and what has such letters goes to the library's own
        rule, which knows all of them."""
        if latin(text):
            return _LATIN.findall(text)
        if self._split is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._split = ByteLevel(add_prefix_space=False).pre_tokenize_str
        found: list[str] = []
        for unit in _UNIT.findall(text):
            found += _LATIN.findall(unit) if latin(unit) else [unit[a:b] for _, (a, b) in self._split(unit)]
        return found

    def _new(self, word: str) -> tuple[int, ...]:
        found = self.old.get(word)
        if found is None:
            found = self.automaton.encode(word.encode())
        if len(word) <= CACHED_LENGTH:
            if len(self.young) >= self.cached:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.special.split(text) if self.special else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                ids.append(self.automaton.special[piece])
                continue
            for word in self.words(piece):
                found = self.young.get(word)
                ids += self._new(word) if found is None else found
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        labels = self.automaton.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec_of(held) -> Codec:
    """The codec of a broadcast automaton, one per Python worker."""
    key = f"{held.id}" if hasattr(held, "id") else str(id(held))
    digest = getattr(held.value, "key", key)
    only_cache("bpe", _codecs.clear)
    if digest not in _codecs:
        _codecs.clear()
        _codecs[digest] = Codec(held.value)
    return _codecs[digest]


def _broadcast(df: DataFrame, path: str):
    automaton = load(path)
    with open(path, "rb") as f:
        automaton.key = hashlib.sha256(f.read()).hexdigest()
    return df.sparkSession.sparkContext.broadcast(automaton)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the tokens of every whole text as ``array<int>``; null counts as empty and has none."""
    held = _broadcast(df, path)

    @F.pandas_udf("array<int>")
    def run(texts):
        return texts.map(codec_of(held).encode)

    return df.withColumn(ids, run(text_or_empty(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of token arrays; null ids give null, ids outside the vocabulary end the job."""
    held = _broadcast(df, path)

    @F.pandas_udf("string")
    def run(rows):
        return rows.map(lambda r: None if r is None else codec_of(held).decode(r))

    return df.withColumn(text, run(F.col(ids)))


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def round_trip(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, encoded and decoded again in one pass.

    Null texts are empty: no tokens. Repeated rows come back as often as they stand there; null ids stay null;
    other columns are not read. An empty table gives no rows.
    """
    held = _broadcast(docs, path)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, counts, digests, texts = codec_of(held), [], [], []
        for cell in batch["text"]:
            ids = codec.encode(cell.as_py())
            counts.append(len(ids))
            numerals = codec.numerals
            digests.append(hashlib.sha256(",".join([numerals[i] for i in ids]).encode()).hexdigest())
            texts.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
        return pa.record_batch([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts)], schema=DIGESTS)

    return via_arrow(docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")), work, DIGESTS)
