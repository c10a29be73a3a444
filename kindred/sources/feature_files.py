"""Feature text files to typed columns, without Python in the loop.

Lines are parsed by column functions only. A line that cannot be parsed gives nulls instead of
failing the job; ``accepted`` drops it and ``load_rejects`` lists it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.ids import EXTENSIONS, normalise, unwrap_bytes

# The letters of the twelve notes, lowest first.
NOTE_LETTERS = "ABCDEFGHIJKL"
# How a usable chroma matrix starts.
CHROMA_STARTS = ("[[0.", "[[1.")

_RECORD = rf"^(.*?\.(?:{'|'.join(EXTENSIONS)}))\s*[;,](.*)$"


def read_lines(spark: SparkSession, pattern: str, min_partitions: int | None = None) -> DataFrame:
    """Text lines of all files that match a glob; many small files are packed into few splits.

    ``min_partitions`` is a least number: lines are dealt out anew only if the scan has fewer splits.
    """
    return _at_least(spark.read.text(pattern), min_partitions)


def _at_least(lines: DataFrame, min_partitions: int | None) -> DataFrame:
    enough = min_partitions is None or lines.rdd.getNumPartitions() >= min_partitions
    return lines if enough else lines.repartition(min_partitions)


def numbers(text: Column) -> Column:
    """All comma-separated numbers of a bracketed text, nesting ignored."""
    flat = F.regexp_replace(text, r"[\[\]\s]", "")
    return F.transform(F.split(flat, ","), lambda x: x.try_cast("double"))


def _usable(parsed: DataFrame, vector: str) -> Column:
    complete = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())
    return F.coalesce((F.col("id") != "") & complete, F.lit(False))


def accepted(parsed: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a vector without gaps."""
    return parsed.filter(_usable(parsed, vector))


def parse_vectors(lines: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """``id,v1,..,vn`` with optional ``b'..'`` wrapping. Here and below, ``keep`` names columns of the lines that stay."""
    fields = F.split("value", ",")
    values = F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))),
                         lambda x: unwrap_bytes(x).try_cast("double"))
    return lines.select(normalise(unwrap_bytes(F.get(fields, F.lit(0)))).alias("id"), values.alias(name), *keep)


def parse_beats(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``id; bpm; [values]``"""
    parts = F.split("value", ";")
    return lines.select(
        normalise(F.get(parts, F.lit(0))).alias("id"), F.trim(F.get(parts, F.lit(1))).try_cast("double").alias("bpm"), numbers(F.get(parts, F.lit(2))).alias("bh"),
        *keep,
    )


def parse_notes(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``id; key; scale; [0..11, ..]``, one letter per note; notes are null if one of them is not a number from 0 to 11."""
    parts = F.split("value", ";")
    values = numbers(F.get(parts, F.lit(3)))
    whole = F.forall(values, lambda n: n.isNotNull() & (n >= 0) & (n < len(NOTE_LETTERS)) & (n == F.floor(n)))
    letters = F.transform(values, lambda n: F.substring(F.lit(NOTE_LETTERS), n.cast("int") + 1, F.lit(1)))
    return lines.select(
        normalise(F.get(parts, F.lit(0))).alias("id"), F.trim(F.get(parts, F.lit(1))).alias("key"), F.trim(F.get(parts, F.lit(2))).alias("scale"),
        F.when(whole, F.array_join(letters, "")).alias("notes"), *keep,
    )


def parse_records(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Mixed-delimiter records: the id ends at an audio extension, the rest is ``body``."""
    return lines.select(
        normalise(F.regexp_extract("value", _RECORD, 1)).alias("id"),
        F.regexp_replace(F.regexp_extract("value", _RECORD, 2), r"\s", "").alias("body"), *keep,
    )


def parse_gaussians(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``id; [mean]; [[covariance]]``: n values hold d means and d x d covariances, n = d + d * d."""
    values = numbers(F.translate("body", ";", ","))
    dim = F.round((F.sqrt(4 * F.size("all") + 1) - 1) / 2).cast("int")
    parsed = parse_records(lines, keep).select("id", values.alias("all"), *keep)
    return parsed.select(
        "id", F.slice("all", F.lit(1), dim).alias("mean"), F.slice("all", dim + 1, F.size("all") - dim).alias("cov"), *keep
    )


def parse_compact_timbre(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``id; [mean]; [var]; [upper covariance]`` as one vector."""
    return parse_records(lines, keep).select("id", numbers(F.translate("body", ";", ",")).alias("mfcc"), *keep)


def is_chroma(body: Column) -> Column:
    """Starting like a matrix of non-negative values below two, with numbers only, the same count on each of twelve lines."""
    starts = [body.startswith(s) for s in CHROMA_STARTS]
    values = numbers(body)
    return (starts[0] | starts[1]) & (F.size(values) % len(NOTE_LETTERS) == 0) & ~F.exists(values, lambda x: x.isNull())


def parse_chroma(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id; [[12 x T]]`` row-major; returns the parsed rows and the rejected lines."""
    records = parse_records(lines)
    good = records.filter(is_chroma(F.col("body"))).select("id", numbers(F.col("body")).alias("chroma"))
    return good, records.filter(~is_chroma(F.col("body")))


def parse_query_list(lines: DataFrame) -> DataFrame:
    """One path per line, optionally ``path : shard``."""
    return lines.select(normalise(F.split_part("value", F.lit(":"), F.lit(1))).alias("id"))


# The file types of a catalogue, and the vector that a usable line must have.
FILE_TYPES = {"rp": "rp", "rh": "rh", "bh": "bh", "notes": "notes", "chroma": "chroma", "mfcckl": "cov"}


def parsed_lines(lines: DataFrame, file_type: str) -> DataFrame:
    """Every line (``value``) of a ``file`` once: ``id`` and its features, ``usable``, and for the others the ``reason`` and the ``line`` itself."""
    keep = ["value", "file"]
    if file_type == "chroma":
        rows = parse_records(lines, keep).select("id", F.when(is_chroma(F.col("body")), numbers(F.col("body"))).alias("chroma"), *keep)
    elif file_type in ("rp", "rh"):
        rows = parse_vectors(lines, file_type, keep)
    else:
        parsers = {"bh": parse_beats, "notes": parse_notes, "mfcckl": parse_gaussians, "mfcc": parse_compact_timbre}
        rows = parsers[file_type](lines, keep)
    if file_type == "notes":
        usable = F.coalesce((F.col("id") != "") & F.col("notes").isNotNull(), F.lit(False))
    else:
        usable = _usable(rows, FILE_TYPES.get(file_type, file_type))
    reason = F.when(F.coalesce(F.col("id"), F.lit("")) == "", F.lit("no id")).otherwise(F.lit("bad values"))
    return rows.select(
        *[c for c in rows.columns if c not in keep], usable.alias("usable"), F.when(~usable, reason).alias("reason"),
        F.when(~usable, F.col("value")).alias("line"), "file",
    )


def load_tables(
    spark: SparkSession, root: str, min_partitions: int | None = None, compact: bool = False, brackets: bool = False
) -> dict[str, DataFrame]:
    """All feature tables below ``root``: ``features<n>/out<n>.<type>``.

    ``compact`` adds the compact timbre files, ``mfcc``. ``brackets`` drops ``[ ]`` from the ids as well.
    """
    found = {}
    for name in [*FILE_TYPES, *(["mfcc"] if compact else [])]:
        rows = _all_lines(spark, root, name, min_partitions).filter("usable").drop("usable", "reason", "line", "file")
        found[name] = rows.withColumn("id", normalise(F.col("id"), brackets=True)) if brackets else rows
    return found


def load_rejects(spark: SparkSession, root: str, min_partitions: int | None = None) -> DataFrame:
    """What ``load_tables`` leaves out: ``file_type, id, reason, line, file`` of every line that could not be used."""
    parts = [
        _all_lines(spark, root, name, min_partitions).filter(~F.col("usable")).select(F.lit(name).alias("file_type"), "id", "reason", "line", "file")
        for name in FILE_TYPES
    ]
    return reduce(DataFrame.unionByName, parts)


def _all_lines(spark: SparkSession, root: str, file_type: str, min_partitions: int | None) -> DataFrame:
    lines = spark.read.text(f"{root}/features[0-9]*/out[0-9]*.{file_type}").select("value", F.col("_metadata.file_path").alias("file"))
    return parsed_lines(_at_least(lines, min_partitions), file_type)
