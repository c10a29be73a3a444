"""Class labels: derive, encode, match, restrict and count them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.ids import match_key
from kindred.operators.scale_out import broadcast_if_small, running_total
from kindred.operators.store import duplicate_ids


def classes_from_ids(rows: DataFrame, separator: str = "/", key: str = "id") -> DataFrame:
    """Class = text before the first separator; fails when no two ids share a class."""
    labelled = rows.withColumn("class", F.split_part(key, F.lit(separator), F.lit(1)))
    if labelled.groupBy("class").count().filter("count > 1").isEmpty():
        raise ValueError("no class holds two ids: the separator does not split a class from the ids")
    return labelled


def encoder(rows: DataFrame, column: str = "class") -> DataFrame:
    """``(class, code)``: codes 0.. in alphabetical order of the classes."""
    names = rows.select(column).filter(F.col(column).isNotNull()).distinct()
    return running_total(names, [], [column], name="position").select(column, (F.col("position") - 1).alias("code"))


def encode(rows: DataFrame, codes: DataFrame, column: str = "class") -> DataFrame:
    return rows.join(broadcast_if_small(codes), column, "left")


def decode(rows: DataFrame, codes: DataFrame, column: str = "class", code: str = "code") -> DataFrame:
    return rows.join(broadcast_if_small(codes), code, "left")


def lookup_classes(ids: DataFrame, classes: DataFrame) -> DataFrame:
    """Class of every id of a list, null where unknown."""
    return ids.join(classes, "id", "left")


def restrict_to_classes(rows: DataFrame, wanted: Sequence | DataFrame, column: str = "class") -> DataFrame:
    """Rows of the given classes: a filter for a list, a semi-join for a table of classes."""
    if isinstance(wanted, DataFrame):
        return rows.join(wanted.select(column), column, "left_semi")
    return rows.filter(F.col(column).isin(list(wanted)))


def class_counts(rows: DataFrame, column: str = "class") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("members"))


def ids_of_class(rows: DataFrame, value, column: str = "class") -> DataFrame:
    return rows.filter(F.col(column) == value).select("id")


def at_least(rows: DataFrame, members: int, column: str = "class") -> DataFrame:
    """Rows of classes with enough members; counted before the join, so a hot class is no burden."""
    large = class_counts(rows, column).filter(F.col("members") >= members)
    return rows.join(broadcast_if_small(large.select(column), computed=True), column, "left_semi")


def majority_baseline(rows: DataFrame, column: str = "class") -> DataFrame:
    """Share of the largest class."""
    counts = class_counts(rows, column)
    return counts.agg((F.max("members") / F.sum("members")).alias("baseline"))


def positive_labels(names: Sequence[str], delimiter: str = ",") -> Column:
    """Names of the columns that hold 1, in column order."""
    marks = [F.when(F.col(n) == 1, F.lit(n)) for n in names]
    return F.array_join(F.filter(F.array(*marks), lambda x: x.isNotNull()), delimiter)


def pending(files: DataFrame, done: DataFrame) -> DataFrame:
    """Ids that have not been processed yet."""
    return files.join(done.select("id"), "id", "left_anti")


def subset_in_order(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of a list ``(id, position)``, sorted like the list."""
    return rows.join(wanted.select("id", "position"), "id").orderBy("position")


def match_report(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("features", "classes")) -> DataFrame:
    """One row per id: in both lists or only in one."""
    tagged = left.select("id", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("id", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    status = F.when((F.max("l") == 1) & (F.max("r") == 1), "both").when(F.max("l") == 1, f"only_{names[0]}")
    return tagged.groupBy("id").agg(status.otherwise(f"only_{names[1]}").alias("status"))


def require_unique(rows: DataFrame, key: str) -> None:
    repeated = duplicate_ids(rows, key).take(1)
    if repeated:
        raise ValueError(f"duplicate id: {repeated[0][key]}")


def align(
    features: DataFrame, classes: DataFrame, strip: bool = False, lower: bool = False, unique: bool = True
) -> DataFrame:
    """Inner join on ids compared without path, extension or case, as asked."""
    keyed = [
        df.withColumn("_key", match_key(F.col("id").cast("string"), strip, lower)).drop("id") for df in (features, classes)
    ]
    if unique:
        for df in keyed:
            require_unique(df, "_key")
    return keyed[0].join(keyed[1], "_key").withColumnRenamed("_key", "id")


def align_predictions(
    predicted: DataFrame, truth: DataFrame, strip: bool = True, lower: bool = False, unique: bool = True
) -> DataFrame:
    """Pair two tables with the same label columns: ``predicted_<c>`` and ``true_<c>``."""
    names = [c for c in predicted.columns if c != "id"]
    if names != [c for c in truth.columns if c != "id"]:
        raise ValueError("predictions and truth have different columns")
    sides = [
        df.select("id", *[F.col(n).alias(f"{side}_{n}") for n in names])
        for side, df in (("predicted", predicted), ("true", truth))
    ]
    return align(*sides, strip=strip, lower=lower, unique=unique)
