"""Inputs derived from the driver's tables; ``checks.sql`` states the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.scale_out import materialise
from kindred.operators.store import gather

# The letter of each event type.
LETTERS = {"click": "A", "error": "B", "purchase": "C", "signup": "D", "view": "E"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vec(spark: SparkSession, sf: str) -> DataFrame:
    values = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.slice(values, 1, 40).alias("rp"),
        F.slice(values, 41, 12).alias("rh"),
        F.slice(values, 53, 12).alias("bh"),
        F.col("label").alias("class"),
    )


def gauss(spark: SparkSession, sf: str) -> DataFrame:
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    parts = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.avg(quantity).alias("m1"),
        F.avg(discount).alias("m2"),
        F.var_samp(quantity).alias("c11"),
        F.covar_samp(quantity, discount).alias("c12"),
        F.var_samp(discount).alias("c22"),
    )
    return parts.select("id", F.array("m1", "m2").alias("mean"), F.array("c11", "c12", "c12", "c22").alias("cov"))


def gauss_bad(spark: SparkSession, sf: str) -> DataFrame:
    """Four rows per supplier: the healthy one (id * 4) and a zero, a singular and a negated covariance."""
    cov = F.col("cov")
    forms = [cov, F.transform(cov, lambda _: F.lit(0.0)), F.transform(cov, lambda _: F.lit(1.0)), F.transform(cov, lambda x: -x)]
    rows = gauss(spark, sf).select("id", "mean", F.posexplode(F.array(*forms)).alias("form", "cov"))
    return rows.select((F.col("id") * 4 + F.col("form")).alias("id"), "mean", "cov")


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol string per user; a sequence is one record by definition."""
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv]), F.col("event_type"))
    rows = table(spark, sf, "events").select("user_id", F.struct("ts", "event_id", letter.alias("letter")).alias("e"))
    ordered = F.sort_array(F.collect_list("e"))
    return rows.groupBy(F.col("user_id").alias("id")).agg(
        F.array_join(F.transform(ordered, lambda e: e["letter"]), "").alias("notes")
    )


def chroma(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 values and eight zeros as 12 lines of six beats."""
    values = F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), 8))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), values.alias("chroma"))


def chroma_var(spark: SparkSession, sf: str) -> DataFrame:
    """The 64 values, filled with zeros to six to nine beats."""
    zeros = (8 + 12 * (F.col("vec_id") % 4)).cast("int")
    values = F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), zeros))
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), values.alias("chroma"))


def store(spark: SparkSession, sf: str) -> DataFrame:
    return gather([f(spark, sf) for f in (vec, gauss, notes, chroma)])


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The gathered store written once per application; later queries start from the file."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        spread = store(spark, sf).repartition(spark.sparkContext.defaultParallelism, F.xxhash64("id"))
        _STORED[key] = materialise(spread, "store")
    return _STORED[key]


def query_list(spark: SparkSession, sf: str) -> DataFrame:
    """The batch of queries: a separate list of ids that does not grow with the catalogue."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per frame: the non-zero bin and its value, ordered by (ts, event_id); signups are beats."""
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv]), F.col("event_type"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("track"),
        "ts",
        "event_id",
        (F.ascii(letter) - 65).alias("bin"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
        (F.col("event_type") == "signup").alias("is_beat"),
    )
