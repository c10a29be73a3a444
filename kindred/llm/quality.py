"""Quality classification by nearest neighbours in a latent-semantic space.

A text becomes counts of terms: trigrams of character classes, and bands of a few properties of the whole text (length,
share of distinct words and of distinct lines, mean length of words). Terms are weighted by tf-idf over a bounded labelled sample and projected on the leading singular
vectors of that sample. The labelled vectors are broadcast (at most ``2 * per_class * dimensions`` numbers); every document is held
against all of them in blocks of exact cosine products, and its nearest neighbours vote, weighted by similarity and by the share of their class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import only_cache, text_or_empty, via_arrow
from kindred.llm.labelled import PER_CLASS, held_out, labelled_sample

DIMENSIONS = 64
NEIGHBOURS = 31
SHARPNESS = 8.0
MAX_TERMS = 3000
BLOCK = 256

CLASSES = 40
BANDS, LEVELS = 4, 16


def _class_of_bytes() -> np.ndarray:
    out = np.full(256, CLASSES - 1, np.int32)
    for c in range(ord("a"), ord("z") + 1):
        out[c] = 0
    for c in range(ord("A"), ord("Z") + 1):
        out[c] = 1
    for c in range(ord("0"), ord("9") + 1):
        out[c] = 2
    out[32], out[10] = 3, 4
    out[0x80:0xC0], out[0xC0:] = 5, 6
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[signs] = 7 + np.arange(len(signs))
    return out


_CLASS = _class_of_bytes().astype(np.uint8).tobytes()
_TERMS = CLASSES**3 + BANDS * LEVELS


def _level(x: float) -> int:
    return int(min(max(x, 0.0), 1.0) * (LEVELS - 1) + 0.5)


def terms_of(text: str) -> tuple[np.ndarray, list[int], int]:
    """Of a whole text: its trigrams in order, its bands, and how often each band counts."""
    data = text.encode("utf-8", "replace")
    kinds = np.frombuffer((b"\n" + data + b"\n").translate(_CLASS), np.uint8).astype(np.uint16)
    trigrams = kinds[:-2] * np.uint16(CLASSES * CLASSES)
    trigrams += kinds[1:-1] * np.uint16(CLASSES)
    trigrams += kinds[2:]
    words, lines = data.split(), data.split(b"\n")
    n = max(1, len(words))
    bands = (
        _level(np.log2(len(data) + 1) / 20), _level(len(set(words)) / n),
        _level(len(set(lines)) / len(lines)), _level(len(data) / n / 20),
    )
    # A property counts as much as a tenth of the text, so that no length drowns it.
    return trigrams, [CLASSES**3 + i * LEVELS + b for i, b in enumerate(bands)], max(1, len(trigrams) // 10)


class Model:
    """``fit`` on labelled texts, then ``score``."""

    def __init__(self, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> None:
        self.dimensions, self.neighbours, self.sharpness = dimensions, neighbours, sharpness

    def _counts(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), len(self.idf)), np.float32)
        for i, t in enumerate(texts):
            trigrams, bands, repeats = terms_of(t)
            row = np.bincount(self.column[trigrams], minlength=len(self.idf) + 1)
            row[self.column[bands]] += repeats
            row = row[1:]
            out[i] = row / max(1, row.sum())
        # A share of 1 % is as far from none as all is from 1 %.
        return np.log1p(out * 100) * self.idf

    def fit(self, texts: list[str], labels: list[int], class_counts: dict[int, int]) -> Model:
        self.prior = class_counts.get(1, 0) / max(1, sum(class_counts.values())) if class_counts else 0.5
        df = np.zeros(_TERMS, np.int64)
        for t in texts:
            trigrams, bands, _ = terms_of(t)
            df[np.flatnonzero(np.bincount(trigrams, minlength=CLASSES**3))] += 1
            df[bands] += 1
        kept = np.argsort(-df, kind="stable")[:MAX_TERMS]
        kept = np.sort(kept[df[kept] >= 2])
        self.column = np.zeros(_TERMS, np.int32)
        self.column[kept] = np.arange(1, len(kept) + 1)
        self.idf = np.log((1 + len(texts)) / (1 + df[kept])).astype(np.float32) + np.float32(0.1)
        if not texts or not len(kept):
            self.basis = np.zeros((len(self.idf), 1), np.float32)
            self.vectors, self.votes, self.weights = np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0)
            return self
        matrix = self._counts(texts)
        rng = np.random.default_rng(7)
        k = min(self.dimensions, *matrix.shape)
        sketch = matrix @ rng.standard_normal((matrix.shape[1], min(k + 16, matrix.shape[1]))).astype(np.float32)
        for _ in range(3):  # power iterations of the randomised singular value decomposition
            sketch, _ = np.linalg.qr(matrix @ (matrix.T @ sketch))
        _, _, right = np.linalg.svd(sketch.T @ matrix, full_matrices=False)
        self.basis = np.ascontiguousarray(right[:k].T, dtype=np.float32)
        self.vectors = self._unit(matrix @ self.basis)
        self.votes = np.array(labels, np.float32)
        share = {c: class_counts.get(c, 0) / max(1, labels.count(c)) for c in (0, 1)}
        self.weights = np.array([share[c] for c in labels], np.float32)
        return self

    @staticmethod
    def _unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]) -> np.ndarray:
        """The share of the votes that are for label 1; the prior for texts without neighbours."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            near = self._unit(self._counts(texts[at : at + BLOCK]) @ self.basis) @ self.vectors.T
            k = min(self.neighbours, near.shape[1])
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            similarity = np.maximum(np.take_along_axis(near, best, axis=1), 0)
            weight = (similarity / np.maximum(similarity.max(axis=1, keepdims=True), 1e-12)) ** self.sharpness
            weight = weight * (similarity > 0) * self.weights[best]
            total = weight.sum(axis=1)
            votes = (weight * self.votes[best]).sum(axis=1)
            out[at : at + len(near)] = np.where(total > 0, votes / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0, 1)


MODULUS, REMAINDER = 4, 2
THRESHOLD = 0.7
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    learn = ~held_out("doc_id", MODULUS, REMAINDER)
    return Model().fit(*labelled_sample(docs, labels, "quality", learn, per_class))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; only the text decides.

    Null and empty texts are scored like any other. Repeated rows come back as often as they stand there; a null id is not
    held out. Without labels every score is 0.5, without neighbours it is the share of label 1.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        only_cache("quality", lambda: None)
        out = np.empty(batch.num_rows)
        for at in range(0, batch.num_rows, BLOCK):
            out[at : at + BLOCK] = held.value.score(batch["text"].slice(at, BLOCK).to_pylist())
        return pa.record_batch([batch["doc_id"], pa.array(out)], schema=SCORES)

    scored = via_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), work, SCORES)
    return scored.select(
        "doc_id", held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns, whatever their names.

    Null and empty texts are scored like any other; ids are not read, so null ones and repeated rows are kept or rejected by
    their texts. Without labels every score is 0.5 and nothing is kept. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    # By mapInArrow as the operators around it: a UDF would have Python workers of its own, beside theirs, which keep their memory.
    given, width = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))]), len(docs.columns)
    text = text_or_empty(f"_c{[c.lower() for c in docs.columns].index('text')}")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        only_cache("quality", lambda: None)
        texts, keep = batch.column(width), np.empty(batch.num_rows, bool)
        for at in range(0, batch.num_rows, BLOCK):
            keep[at : at + BLOCK] = held.value.score(texts.slice(at, BLOCK).to_pylist()) >= THRESHOLD
        return batch.select(list(range(width))).filter(pa.array(keep))

    return via_arrow(given.withColumn("_text", text), work, given.schema).toDF(*docs.columns)
