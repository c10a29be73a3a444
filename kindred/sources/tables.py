"""Result, class and feature tables on disk. Every writer is distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


FILE_BYTES = 128 << 20


def compact(spark: SparkSession, pattern: str, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Rewrite many small text files as files of about ``file_bytes``.

    The scan packs small files and cuts large ones to splits of that size, and each is written as one file: no line is shuffled.
    """
    wanted = {"maxPartitionBytes": str(file_bytes), "openCostInBytes": "0", "minPartitionNum": "1"}
    before = {k: spark.conf.get(f"spark.sql.files.{k}", None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(f"spark.sql.files.{k}", v)
        spark.read.text(pattern).write.text(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(f"spark.sql.files.{k}") if v is None else spark.conf.set(f"spark.sql.files.{k}", v)


def write_header_csv(vectors: DataFrame, name: str, path: str) -> None:
    """``ID,features`` with the values separated by blanks."""
    text = F.array_join(F.transform(name, lambda x: x.cast("string")), " ")
    vectors.select(F.col("id").alias("ID"), text.alias("features")).write.option("header", True).csv(path)


def read_header_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    rows = spark.read.schema("ID string, features string").option("header", True).csv(path)
    values = F.transform(F.split("features", " "), lambda x: x.cast("double"))
    return rows.select(F.col("ID").alias("id"), values.alias(name))


def write_results(results: DataFrame, path: str, form: str = "csv", by_query: bool = True) -> None:
    """One folder per query. Rows are dealt by ranges of query, score and id first, so that a query has few files, each in order,
    and a long list is still written by many tasks."""
    order = [c for c in ("query_id", "aggregated", "id") if c in results.columns]
    if by_query:
        results = results.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = results.write.format(form).option("header", True)
    (writer.partitionBy("query_id") if by_query else writer).save(path)


def read_results(spark: SparkSession, path: str, schema: StructType | str, form: str = "csv") -> DataFrame:
    """Typed read of one or many result files; headers are skipped and checked against the schema."""
    return spark.read.format(form).schema(schema).option("header", True).option("enforceSchema", False).load(path)


def write_features(features: DataFrame, path: str, mode: str = "append") -> None:
    """Long rows ``(feature, id[, id2], values)``, one folder per feature type."""
    features.write.mode(mode).partitionBy("feature").parquet(path)


def read_features(spark: SparkSession, paths: Sequence[str], feature: str) -> DataFrame:
    """Stack one feature type of several sets; only its folders are read."""
    sets = [spark.read.parquet(p).filter(F.col("feature") == feature).drop("feature") for p in paths]
    stacked = sets[0]
    for other in sets[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked


def write_classes(classes: DataFrame, path: str) -> None:
    """``id TAB class`` without a header."""
    classes.select("id", "class").write.option("sep", "\t").csv(path)


def read_classes(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    return spark.read.schema("id string, class string").option("sep", separator).csv(path)


def write_label_table(labels: DataFrame, names: Sequence[str], path: str, positive: str = "x") -> None:
    """Wide table of 0/1 columns, written as ``x`` and empty."""
    marks = [F.when(F.col(n) == 1, F.lit(positive)).otherwise(F.lit("")).alias(n) for n in names]
    labels.select("id", *marks).write.option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def _flag(name: str, positive: str, negative: str) -> Column:
    text = F.coalesce(F.col(name), F.lit(negative))
    return F.when(text == positive, 1).when((text == negative) | (text == "0"), 0).when(text == "1", 1)


def read_label_table(
    spark: SparkSession, path: str, names: Sequence[str], positive: str = "x", negative: str = "", separator: str = "\t"
) -> DataFrame:
    """``x`` to 1, empty to 0; any other entry stops the job that reads it."""
    schema = "id string, " + ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.schema(schema).option("sep", separator).option("header", True).csv(path)
    checked = []
    for n in names:
        flag = _flag(n, positive, negative)
        wrong = F.raise_error(F.concat(F.lit(f"unrecognised entry in column {n}: "), F.col(n))).cast("int")
        checked.append(F.when(flag.isNotNull(), flag).otherwise(wrong).alias(n))
    return raw.select("id", *checked)


def wrong_label_entries(raw: DataFrame, names: Sequence[str], positive: str = "x", negative: str = "") -> DataFrame:
    """How many entries of each column are neither positive, negative nor empty."""
    return raw.agg(*[F.count_if(_flag(n, positive, negative).isNull()).alias(n) for n in names])
