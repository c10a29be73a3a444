"""Bounded samples of labelled documents, on which the classifiers of this package are fitted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import text_or_empty

PER_CLASS = 2000
SAMPLE_CHARS = 24_000_000


def held_out(id: str, modulus: int, remainder: int) -> Column:
    """Whether a row is kept from learning: by the CRC-32 of its id as text. False for a null id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def known_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """``doc_id, label`` (0 or 1), one row per id that may be learnt from; ids with both labels are left out."""
    rows = labels.filter(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    both = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other"))
    return both.filter(F.col("label") == F.col("other")).select("doc_id", F.col("label").cast("int").alias("label"))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS, chars: int = SAMPLE_CHARS
) -> tuple[list[str], list[int], dict[int, int]]:
    """Texts and labels of at most ``per_class`` rows of each class, and how many rows each class has.

    Rows are taken in the order of a hash of their id, while the texts of a class have at most ``chars / 2`` characters; a text longer than that is
    no example. Both bounds hold for any size of the tables, so what reaches the driver does not grow.
    """
    known = known_labels(labels, label, learn)
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows of two numbers
    # An id that stands in very many rows gives each of its texts once.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(few, "doc_id").distinct()
    size = F.sum(F.length("text") + 1).over(
        Window.partitionBy("label").orderBy(*order, "text").rowsBetween(Window.unboundedPreceding, 0)
    )
    small = rows.filter(F.length("text") <= chars // 2).withColumn("upto", size).filter(F.col("upto") <= chars // 2)
    found: pa.Table = small.orderBy("label", *order, "text").select("text", "label").limit(2 * per_class).toArrow()
    return found["text"].to_pylist(), found["label"].to_pylist(), counts
