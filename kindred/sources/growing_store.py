"""A stored catalogue that grows: it knows which files it holds, and what it may promise about its rows.

Below the store, ``version=<k>`` holds the items that became complete with version k. Beside them, hidden from readers of the items, lie the parsed lines of every file type
(``_features``), the list of files (``_files``) and a line of facts (``_manifest``). The facts are written last: a version without them does not count, and the next
build writes over it. So a build that was cut off, or is started twice, leaves the store as if it had run once.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators.store import Catalogue, gather
from kindred.sources.feature_files import FILE_TYPES, parsed_lines

FACTS = "version int, items long, unique boolean, dimensions string, files long"
# Vectors whose lengths are noted.
VECTORS = ("rp", "rh", "bh", "mean", "cov")


def _facts(spark: SparkSession, path: str) -> list:
    """A row per build that was finished."""
    try:
        return spark.read.schema(FACTS).json(f"{path}/_manifest/version=*").orderBy("version").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def open_catalogue(spark: SparkSession, path: str) -> Catalogue | None:
    """The store at ``path``, its rows with the ``version`` that brought them, or ``None`` if nothing was built there."""
    facts = _facts(spark, path)
    if not facts:
        return None
    rows = spark.read.option("basePath", path).parquet(*[f"{path}/version={f['version']}" for f in facts])
    return Catalogue(rows, facts[-1]["unique"], facts[-1]["items"], json.loads(facts[-1]["dimensions"]))


def pending_files(spark: SparkSession, root: str, path: str) -> DataFrame:
    """``file_type, path, length, modificationTime`` of the feature files below ``root`` that the store at ``path`` has not taken; a changed file counts as new."""
    found = []
    for name in FILE_TYPES:
        try:
            listed = spark.read.format("binaryFile").load(f"{root}/features[0-9]*/out[0-9]*.{name}")
        except AnalysisException as error:  # a type may come with a later build
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(listed.select(F.lit(name).alias("file_type"), "path", "length", "modificationTime"))
    if not found:
        raise FileNotFoundError(f"no feature files below {root}")
    files, facts = reduce(DataFrame.unionByName, found), _facts(spark, path)
    if not facts:
        return files
    taken = spark.read.parquet(*[f"{path}/_files/version={f['version']}" for f in facts])
    return files.join(taken, ["path", "length", "modificationTime"], "left_anti")


def _features(spark: SparkSession, path: str, name: str, versions: list[int]) -> DataFrame:
    """All lines of a file type that the versions took."""
    schema = parsed_lines(spark.createDataFrame([], "value string, file string"), name).schema
    return spark.read.schema(schema).option("basePath", f"{path}/_features/{name}").parquet(*[f"{path}/_features/{name}/version={v}" for v in versions])


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """``file_type, id, reason, line, file`` of all lines that could not be used, from the tables that the builds wrote."""
    versions = [f["version"] for f in _facts(spark, path)]
    parts = [
        _features(spark, path, name, versions).filter(~F.col("usable")).select(F.lit(name).alias("file_type"), "id", "reason", "line", "file")
        for name in FILE_TYPES
    ]
    return reduce(DataFrame.unionByName, parts)


def extend(spark: SparkSession, root: str, path: str) -> Catalogue | None:
    """Take in the feature files below ``root`` that the store at ``path`` does not hold yet; without new files nothing is written.

    Only new files are read, each once: usable lines and rejects go to one table, told apart by its partitions. Items that are complete now, with all file types, join the
    store; an item that it holds already stays as it is, whatever newer lines say. Copies of rows are dropped.
    """
    before = [f["version"] for f in _facts(spark, path)]
    # Spark's own reader holds the paths of all files in the driver, too.
    new = pending_files(spark, root, path).collect()
    if not new:
        return open_catalogue(spark, path)
    version = max(before, default=0) + 1
    files = [(r["path"], r["length"], r["modificationTime"]) for r in new]
    spark.createDataFrame(files, "path string, length long, modificationTime timestamp").write.mode("overwrite").parquet(f"{path}/_files/version={version}")
    nothing = spark.createDataFrame([], "value string, file string")
    for name in FILE_TYPES:
        paths = [r["path"] for r in new if r["file_type"] == name]
        lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("file")) if paths else nothing
        parsed_lines(lines, name).write.mode("overwrite").partitionBy("usable").parquet(f"{path}/_features/{name}/version={version}")

    def usable(name: str, versions: list[int]) -> DataFrame:
        return _features(spark, path, name, versions).filter("usable").drop("usable", "reason", "line", "file", "version")

    touched = reduce(DataFrame.unionByName, [usable(name, [version]).select("id") for name in FILE_TYPES]).distinct()
    if before:
        held = spark.read.parquet(*[f"{path}/version={v}" for v in before]).select("id")
        touched = touched.join(held, "id", "left_anti")
    tables = [usable(name, [*before, version]).join(touched, "id", "left_semi") for name in ("chroma", "mfcckl", "notes", "rp", "rh", "bh")]
    items = gather(tables, distinct=True)
    items.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/version={version}")
    rows = spark.read.parquet(*[f"{path}/version={v}" for v in [*before, version]])
    facts = rows.agg(
        F.lit(version).alias("version"), F.count("*").alias("items"), (F.count_distinct("id") == F.count("*")).alias("unique"),
        F.to_json(F.struct(*[F.max(F.size(v)).alias(v) for v in VECTORS])).alias("dimensions"), F.lit(len(files)).alias("files"),
    )
    facts.coalesce(1).write.mode("overwrite").json(f"{path}/_manifest/version={version}")
    return open_catalogue(spark, path)
