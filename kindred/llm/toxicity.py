"""Toxicity by multiple-instance learning: documents have labels, their sentences are scored.

A sentence's log-odds is a bias plus the weights of its distinct words and of their first letters. What the bias alone gives
counts once per document, as the leak of a noisy-or; above it, a document is toxic if any sentence is. So sentences without evidence change nothing, however
many they are. Weights are learnt from document labels alone, on a bounded sample of labelled rows, by gradient
steps through the noisy-or, so that blame settles on the sentences that explain it. These are located afterwards.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import only_cache, text_or_empty, via_arrow
from kindred.llm.labelled import PER_CLASS, held_out, labelled_sample

PREFIXES = (4, 5, 6, 7)
LEAST_ROWS, LEAST_SHARE = 4, 0.005
STEPS = 150
RATE = 0.1
SHRINK = 1e-3
BIAS = -4.0
CACHED_WORDS = 200_000

_END = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")
_WORD_OR_END = re.compile(r"(\w+)|[.!?\n]")


def features_of(word: str) -> list[str]:
    """The word itself and its beginnings, marked so that they differ from words."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class _Weights(dict):
    """Weight per word; unknown words are worked out from their features."""

    def __init__(self, features: dict[str, float]) -> None:
        super().__init__()
        self.features = features

    def __missing__(self, word: str) -> float:
        weight = sum(self.features.get(f, 0.0) for f in features_of(word))
        if len(self) < CACHED_WORDS and len(word) <= 64:
            self[word] = weight
        return weight


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


class Model:
    def __init__(self) -> None:
        self.features: dict[str, float] = {}
        self.bias = BIAS
        self._weights: _Weights | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_weights": None}

    def fit(self, texts: list[str], labels: list[int], class_counts: dict[int, int]) -> Model:
        """Learn from whole texts; a class counts as often as it has labelled rows, whatever its share of the sample."""
        index: dict[str, int] = {}
        rows: list[int] = []
        sentence_of: list[int] = []
        doc_of: list[int] = []
        df: dict[int, int] = {}
        for d, text in enumerate(texts):
            seen: set[int] = set()
            for sentence in _END.split(text.lower()):
                words = sorted(set(_WORD.findall(sentence)))
                if not words:
                    continue
                s = len(doc_of)
                doc_of.append(d)
                found = [index.setdefault(f, len(index)) for w in words for f in features_of(w)]
                rows += found
                sentence_of += [s] * len(found)
                seen.update(found)
            for f in seen:
                df[f] = df.get(f, 0) + 1
        if not doc_of or len(set(labels)) < 2:
            share = class_counts.get(1, 0) / max(1, sum(class_counts.values())) if class_counts else 0.0
            self.bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
            return self
        # Words of a few documents and their copies explain nothing else.
        least = max(LEAST_ROWS, LEAST_SHARE * len(texts))
        common = np.array([df[i] >= least for i in range(len(index))])
        renamed = np.cumsum(common) - 1
        feature, sentence = np.array(rows), np.array(sentence_of)
        kept = common[feature]
        feature, sentence = renamed[feature[kept]], sentence[kept]
        doc, y = np.array(doc_of), np.array(labels, float)
        n, n_sentences = len(texts), len(doc_of)
        share = np.array([class_counts.get(c, 0) / max(1, labels.count(c)) for c in (0, 1)])
        weight = share[np.array(labels)]
        weight = weight / weight.mean()
        w, bias = np.zeros(int(common.sum())), BIAS
        moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, STEPS + 1):
            z = bias + np.bincount(sentence, w[feature], n_sentences)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            leak = 1 / (1 + np.exp(-bias))
            none = np.exp(-np.bincount(doc, _softplus(z) - _softplus(bias), n) - _softplus(bias))  # nothing is toxic
            pull = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0) * weight
            slope = pull[doc] * p
            by_bias = (pull[doc] * (p - leak)).sum() + (pull * leak).sum()
            gradient = np.append(np.bincount(feature, slope[sentence], len(w)), by_bias) / n
            moment = 0.9 * moment + 0.1 * gradient
            square = 0.99 * square + 0.01 * gradient**2
            change = RATE * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            # Evidence only adds: clean words do not make up for a toxic one, and rare words fade.
            w, bias = np.maximum(w - change[:-1] - RATE * SHRINK, 0), bias - change[-1]
        names = [f for f, i in index.items() if common[i]]
        self.features = {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}
        self.bias = float(bias)
        return self

    def forget(self) -> None:
        self._weights = None

    def _odds(self, words: set[str]) -> float:
        if self._weights is None:
            self._weights = _Weights(self.features)
        return self.bias + sum(map(self._weights.__getitem__, words))

    def score(self, text: str) -> float:
        """Noisy-or of the leak and of the sentences; a text without words has the leak alone."""
        find = _WORD.findall
        z = [self._odds(words) for sentence in _END.split(text.lower()) if (words := set(find(sentence)))]
        leak = _softplus(self.bias)
        return float(-np.expm1(-(leak + (_softplus(np.array(z)) - leak).sum())))

    def locate(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """(start, end, score) of the sentences that reach ``least``, in code points of the text."""
        # Lower-casing can lengthen a text, so words are lower-cased one by one here.
        found, words, start, end = [], set(), 0, 0
        for m in [*_WORD_OR_END.finditer(text), None]:
            if m is not None and m[1]:
                start = start if words else m.start()
                words.update(_WORD.findall(m[1].lower()))
                end = m.end()
            elif words:
                p = float(-np.expm1(_softplus(self.bias) - _softplus(self._odds(words))))
                found += [(start, end, p)] if p >= least else []
                words = set()
        return found


    def strongest(self, text: str) -> list[tuple[int, int, float]]:
        """The one sentence that adds most, the first of equals; none without words."""
        return sorted(self.locate(text, -1.0), key=lambda s: -s[2])[:1]


MODULUS, REMAINDER = 5, 0
THRESHOLD = 0.5
SCORES = pa.schema([
    ("doc_id", pa.int64()), ("score", pa.float64()),
    ("offending", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    learn = ~held_out("doc_id", MODULUS, REMAINDER)
    return Model().fit(*labelled_sample(docs, labels, "toxic", learn, per_class))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` of every row; only the text decides.

    ``offending`` has the sentences that reach the threshold on their own, for documents that are predicted toxic; where weaker ones only sum up, the strongest. Null counts as
    empty; repeated rows come back as often as they stand there; a null id is not held out. Without labels of both classes all
    scores are nearly the share of toxic labels.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        only_cache("toxicity", held.value.forget)
        model, scores, places = held.value, [], []
        for cell in batch["text"]:
            text = cell.as_py()
            scores.append(model.score(text))
            found = (model.locate(text) or model.strongest(text)) if scores[-1] >= THRESHOLD else []
            places.append([{"start": a, "end": b, "score": p} for a, b, p in found])
        return pa.record_batch([batch["doc_id"], pa.array(scores, pa.float64()), pa.array(places, SCORES.field("offending").type)], schema=SCORES)

    scored = via_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), work, SCORES)
    return scored.select(
        "doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending",
    )
