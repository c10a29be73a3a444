"""A corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import exact_dedup, minhash, packing, quality, secrets
from kindred.llm.common import materialise, table
from kindred.llm.queries import WORD_VOCABULARY


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of the documents it is given.

    Only texts decide, null ones count as empty: rows that repeat, or have a null id, are kept or rejected by their texts. No rows give no rows.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the smallest id, null ids last; of rows that repeat an id and a text, one.

    Null counts as empty, so one of all null and empty texts stays. No rows give no rows.
    """
    return exact_dedup.keep_distinct(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest id.

    Texts without words and rows with a null id are linked with nothing and stay; rows that repeat an id and a text stay or go together. No rows give no rows.
    """
    return minhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark. Null and empty texts stay as they are, repeated rows and null ids stay. No rows give no rows."""
    return secrets.redact(docs, secrets.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands in the training sequences.

    Null and empty texts are one piece, the end token; repeated rows are packed as often as they stand there. No rows give no rows.
    """
    return packing.pack_documents(docs, WORD_VOCABULARY)


STAGES = [
    ("quality", good_quality),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("secrets", without_secrets),
    ("packing", packed),
]

# A classifier and a network decide what stays, so SQL has no answer; tests hold a brute-force version against it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``. Columns of any name, beside those of the table, pass through all stages but the last."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return docs
