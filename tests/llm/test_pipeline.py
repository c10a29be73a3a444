"""The stages of the pipeline against plain versions of each, every stage on its own input."""

import re

import pytest

import corpus_pipeline as C
from kindred.llm import quality, secrets
from kindred.llm.common import materialise, table
from test_minhash import brute as groups_of
from test_secrets import brute as spans_of

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [n for n, _ in C.STAGES] == ["quality", "exact dedup", "near dedup", "secrets", "packing"]
    inputs, outputs = [], []
    for _, stage in C.STAGES:
        out = materialise(stage(spark, docs, SF), "test")
        inputs.append({r.doc_id: r for r in docs.collect()})
        outputs.append(out.collect())
        docs = out
        if len(outputs) < 5:
            assert out.columns == columns
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = {i for i, r in inputs[0].items() if model.score([r.text or ""])[0] >= quality.THRESHOLD}
    assert {r.doc_id for r in outputs[0]} == good
    first = {}
    for i in sorted(inputs[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", inputs[1][i].text or ""), i)
    assert {r.doc_id for r in outputs[1]} == set(first.values())
    kept = {i for i, _, _, keep in groups_of([(i, r.text) for i, r in inputs[2].items()]) if keep}
    assert {r.doc_id for r in outputs[2]} == kept
    network = secrets.train(table(spark, SF, "documents"))
    for r in outputs[3]:
        before = inputs[3][r.doc_id].text
        assert not spans_of(r.text) or spans_of(before)
        if not spans_of(before) and network.threshold > 1:
            assert r.text == before
        assert r.n_chars == len(r.text)
    assert {r.doc_id for r in outputs[4]} == set(inputs[4])


@pytest.mark.parametrize("rows", [[], [(None, None), (None, "same text"), (1, "same text"), (1, "same text"), (2, ""), (3, "w " * 200_000), (4, None)]])
def test_stages_on_odd_rows(spark, documents, rows):
    """Every stage takes nulls, repeats, long texts, no rows and columns of any name; all but the last keep the columns."""
    docs = documents(rows).selectExpr("*", *[f"'x' AS {c}" for c in ("_clean", "_dropped", "_sha", "_id", "_c0", "_text", "t1", "component_id", "sequence_id")])
    for name, stage in C.STAGES:
        out = materialise(stage(spark, docs, SF), "odd")
        given = {(r.doc_id, r.text) for r in docs.collect()}
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {i for i, _ in given}
            continue
        assert out.columns == docs.columns
        left = [(r.doc_id, r.text) for r in out.collect()]
        assert set(left) <= given
        if name == "exact dedup":
            assert len({t or "" for _, t in left}) == len(left) == len({t or "" for _, t in given})
        # Stages that dropped all would leave nothing to try the others on.
        docs = out if name != "quality" else docs


def test_run_and_registration(spark):
    from __spark_entry__ import oracle_sql, queries

    names = {k.split("_")[0] for k in queries() if re.match(r"op\d+_", k)}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in queries() and "pipeline" not in oracle_sql()
    assert queries()["pipeline"](spark, SF).count() > 0
