"""Held-out accuracy, the rule for held-out rows, and the cases a classifier must stand."""

import random
import zlib

import numpy as np
import pytest

from kindred.llm import labelled, quality, toxicity
from kindred.llm.common import table

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def accuracy(spark, scored, label):
    labels = table(spark, SF, "labels").toPandas().dropna(subset=[label])
    rows = scored.toPandas().merge(labels, on="doc_id")
    held = rows[rows.held_out]
    positive, negative = held[held[label] == 1], held[held[label] == 0]
    return positive.predicted.mean(), negative.predicted.mean(), held


def test_quality_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    kept, let_through, held = accuracy(spark, quality.classify(docs, quality.train(docs, table(spark, SF, "labels"))), "quality")
    assert kept > 0.99 and let_through < 0.05
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id)
    assert held.score.between(0, 1).all() and ((held.score >= 0.7) == (held.predicted == 1)).all()


def test_toxicity_on_held_out_rows_and_its_sentences(spark):
    docs = table(spark, SF, "documents")
    scored = toxicity.score_documents(docs, toxicity.train(docs, table(spark, SF, "labels")))
    found, wrong, held = accuracy(spark, scored, "toxic")
    assert found > 0.8 and wrong < 0.01
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held.doc_id)
    texts = {r.doc_id: r.text for r in docs.join(spark.createDataFrame([(int(i),) for i in held.doc_id[held.predicted == 1]], "doc_id long"), "doc_id").collect()}
    for row in held[held.predicted == 1].itertuples():
        assert len(row.offending) > 0
        for place in row.offending:
            assert not set(texts[row.doc_id][place["start"] : place["end"]]) & set(".!?\n") and (place["score"] >= 0.5 or len(row.offending) == 1)


def examples(rng, n=120):
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    clean = [". ".join(" ".join(word() for _ in range(8)) for _ in range(rng.randint(2, 9))) for _ in range(n)]
    toxic = [c.replace(". ", f" {rng.choice(['zzgrim', 'zzfoul'])}. ", 1) for c in clean[: n // 2]]
    return clean, toxic


def test_blame_settles_on_the_sentence():
    rng = random.Random(1)
    clean, toxic = examples(rng)
    model = toxicity.Model().fit(clean + toxic, [0] * len(clean) + [1] * len(toxic), {0: 120, 1: 60})
    text = "abcde fghab. cdefg zzfoul habcd! abcde"
    assert [text[a:b] for a, b, _ in model.locate(text)] == ["cdefg zzfoul habcd"]
    assert model.score(text) > 0.5 > model.score("abcde fghab. cdefg") and model.score("") < 0.5
    assert model.score("abcde. " * 5000) < 0.5  # a long text is no evidence


def test_weak_sentences_that_sum_up_show_the_strongest():
    model = toxicity.Model()
    model.features, model.bias = {"bad": 1.4, "two": 0.1}, -2.0
    text = "one bad. two bad. three bad"
    assert model.score(text) > 0.5 and model.locate(text) == []
    assert [text[a:b] for a, b, _ in model.strongest(text)] == ["two bad"]
    assert model.strongest("") == model.strongest("...") == []


def test_noisy_or_is_that_of_the_sentences():
    model = toxicity.Model()
    model.features, model.bias = {"bad": 3.0, "worse": 4.0}, -2.0
    p = lambda z: 1 / (1 + np.exp(-z))
    none = 1 - p(-2)
    want = 1 - none * ((1 - p(1)) / none) * ((1 - p(5)) / none)
    assert model.score("Bad bad. fine! worse BAD") == pytest.approx(want)


def test_votes_against_a_plain_sum():
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc DEF!!\n", k=80)) for _ in range(60)]
    labels = [int("!" in t[:20]) for t in texts]
    model = quality.Model(neighbours=7).fit(texts, labels, {0: 30, 1: 90})
    queries = ["abc abc", "", "DEF!! " * 40, texts[3]]
    vectors = model._unit(model._counts(queries) @ model.basis)
    for v, got in zip(vectors, model.score(queries), strict=True):
        near = sorted(((max(0.0, float(v @ w)), i) for i, w in enumerate(model.vectors)), reverse=True)[:7]
        weight = [(s / near[0][0]) ** model.sharpness * model.weights[i] if near[0][0] else 0 for s, i in near]
        want = sum(w * labels[i] for w, (_, i) in zip(weight, near, strict=True)) / sum(weight) if sum(weight) else model.prior
        assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_rows_that_need_a_defined_result(spark, documents, module):
    rows = [(1, None), (2, ""), (3, "word " * 200_000), (None, "x"), (4, "twice"), (4, "twice")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (3, None, None), (99, 1, 1), (3, 7, 7)], LABELS)
    score = quality.classify if module is quality else toxicity.score_documents
    for known in (labels, spark.createDataFrame([], LABELS)):
        got = score(documents(rows), module.train(documents(rows), known)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert score(documents([]), module.train(documents([]), labels)).collect() == []


def test_rejection_reads_texts_only(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    rows = [(i, "Some words, as usual. " * 9 if i % 2 else "####!!! 00 ###") for i in range(40)] + [(None, "Some words, as usual."), (50, None), (51, ""), (1, "###")]
    docs = documents(rows).selectExpr("*", *[f"'x' AS {c}" for c in ("_c0", "held_out", "predicted")])
    model = quality.train(docs, labels)
    want = sorted(str((i, t)) for i, t in rows if model.score([t or ""])[0] >= quality.THRESHOLD)
    left = quality.keep_good(docs, model)
    assert left.columns == docs.columns and 0 < len(want) < len(rows)
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == want
    assert quality.keep_good(docs, quality.train(docs, spark.createDataFrame([], LABELS))).collect() == []
    assert quality.keep_good(documents([]), model).collect() == []


def test_samples_are_bounded_and_leave_out_contradictions(spark, documents):
    rows = [(i, f"text {i}") for i in range(50)] + [(60, "y" * 400)]
    marks = [(i, i % 2, 0) for i in range(50)] + [(60, 1, 0), (7, 0, 0)]
    labels = spark.createDataFrame(marks, LABELS)
    learn = ~labelled.held_out("doc_id", 4, 2)
    texts, found, counts = labelled.labelled_sample(documents(rows), labels, "quality", learn, per_class=5, chars=600)
    assert found.count(0) == found.count(1) == 5 and "text 7" not in texts
    known = [i for i in (*range(50), 60) if zlib.crc32(str(i).encode()) % 4 != 2 and i != 7]
    assert counts == {0: sum(i % 2 == 0 and i != 60 for i in known), 1: sum(i % 2 == 1 or i == 60 for i in known)}
    texts, found, _ = labelled.labelled_sample(documents(rows), labels, "quality", learn, per_class=50, chars=200)
    assert sum(len(t) + 1 for t, c in zip(texts, found, strict=True) if c) <= 100 and "y" * 400 not in texts
