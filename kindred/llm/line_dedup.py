"""Line deduplication over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table of line keys, bucketed and sorted by their 128-bit hash: how many documents of a batch hold the key, and the document
that keeps it, if no earlier run has the key. A new batch is merged against the runs: an anti-join finds its new keys, which get a holder,
a semi-join those already held, and both become a run of level 0. ``fan_in`` runs of a level are compacted to one of the next,
so n batches leave less than ``fan_in`` runs on each of log n levels, and a key is rewritten once per level. All runs have the same buckets, so
the joins do not shuffle them.

Documents come in batches of falling ids, so the first batch that holds a key has its largest id. Counts are summed where
lines are read, before any shuffle, so a line of a third of all documents arrives once per map task.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import materialise, text_or_empty
from kindred.operators.scale_out import scratch_path

KEY = ["k1", "k2"]
# The white space stripped from lines, and the letters that are lower-cased.
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_DOCS = 40, 5
BATCHES, FAN_IN = 6, 3
# A key is hot above this share of all lines, so there are at most so many hot keys.
HOT_KEYS = 20_000


def line_key(line: Column) -> Column:
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANK))


def hashed(value: Column, *names: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), value).alias(n) for i, n in enumerate(names)]


class LineRuns:
    """The runs of one index. ``add`` takes batches, ``merged`` gives the sums over all runs, ``close`` forgets the tables."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in = spark, max(2, fan_in)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._paths: dict[str, str] = {}

    def _written(self, run: DataFrame) -> str:
        name = f"kindred_run_{uuid.uuid4().hex}"
        self._paths[name] = scratch_path(self.spark, "run")
        (
            run.write.format("parquet").option("path", self._paths[name])
            .bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        )
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of ``doc_id, k1, k2``. A key that no run has yet is held by the largest id of the batch."""
        keys = batch.distinct().groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        # Every key has a holder in exactly one run.
        fresh, known = keys, []
        for held in [r.filter("holder is not null").select(*KEY) for r in self.runs()]:
            fresh = fresh.join(held, KEY, "left_anti")
            known.append(keys.join(held, KEY, "left_semi").withColumn("holder", F.lit(None).cast("long")))
        run = reduce(DataFrame.unionByName, known, fresh)
        self.levels[0].append(self._written(run))
        for level, tables in enumerate(self.levels):
            if len(tables) >= self.fan_in:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._written(self._sum(tables)))
                tables.clear()

    def _sum(self, tables: list[str]) -> DataFrame:
        # One scan of their files: Spark 4.1 takes a union of bucketed tables to be bucketed, but puts their buckets one after another.
        rows = self.spark.read.schema("k1 long, k2 long, n_docs long, holder long").parquet(*[self._paths[t] for t in tables])
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    def merged(self) -> DataFrame:
        """``k1, k2, n_docs, holder`` of every key."""
        return self._sum([t for level in self.levels for t in level])

    def close(self) -> None:
        for name in self._paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._paths.clear()


def frequent_lines(
    lines: DataFrame, cuts: list[int], min_docs: int = MIN_DOCS, fan_in: int = FAN_IN, buckets: int | None = None
) -> DataFrame:
    """The keys of ``lines`` (``_batch, doc_id, k1, k2``) that at least ``min_docs`` documents hold, with their number and holder.

    Batch 0 has the ids from ``cuts[-1]`` on, and so down to the last batch.
    """
    index = LineRuns(lines.sparkSession, buckets, fan_in)
    for batch in range(len(cuts) + 1):
        index.add(lines.filter((F.col("_batch") == batch) & F.col("doc_id").isNotNull()).select("doc_id", *KEY))
    found = materialise(index.merged().filter(F.col("n_docs") >= min_docs), "frequent")
    index.close()
    return found


def dedup_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS,
    batches: int = BATCHES, fan_in: int = FAN_IN, buckets: int | None = None,
) -> DataFrame:
    """``doc_id, kept_text, n_lines, n_dropped`` of every row.

    Lines end at line feeds; a null or empty text is one empty line. The key of a line is the line without ASCII white space at both ends, A-Z
    lower-cased. Keys of at least ``min_length`` code points in at least ``min_docs`` documents lose their lines, except all those in the largest
    id that holds the key. Documents are ids: rows that repeat an id count once and hold together, and each has a row of the
    result. Rows without an id neither count nor hold. Other columns are not read. An empty table gives no rows.
    """
    whole = docs.select(F.col(id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    whole = whole.select("*", *hashed(F.col("text"), "t1", "t2"))
    shares = [i / batches for i in range(1, batches)]
    cuts = whole.agg(F.percentile_approx("doc_id", shares, 1000).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    batch = sum((F.when(F.col("doc_id") < c, 1).otherwise(0) for c in cuts), F.lit(0))
    keys = F.transform(F.split("text", "\n", -1), line_key)
    keyed = whole.select("doc_id", "t1", "t2", F.posexplode(keys).alias("pos", "key"))
    keyed = keyed.filter(F.char_length("key") >= min_length)
    # Written once, a folder per batch: narrow rows, so neither the runs nor the joins below read a text.
    path = scratch_path(docs.sparkSession, "lines")
    keyed.select("doc_id", "t1", "t2", "pos", *hashed(F.col("key"), *KEY), batch.alias("_batch")).write.partitionBy("_batch").parquet(path)
    schema = "doc_id long, t1 long, t2 long, pos int, k1 long, k2 long, _batch int"
    lines = docs.sparkSession.read.schema(schema).parquet(path)
    frequent = frequent_lines(lines, cuts, min_docs, fan_in, buckets).select(*KEY, "n_docs", "holder")

    # Each hot key has more than 1 / HOT_KEYS of all lines, so they are fewer than HOT_KEYS and small enough to broadcast; all others meet by key.
    least = lines.count() / HOT_KEYS
    hot = F.broadcast(frequent.filter(F.col("n_docs") > max(least, 1000)).select(*KEY, "holder"))
    rest = frequent.filter(F.col("n_docs") <= max(least, 1000)).select(*KEY, "holder")
    cold = lines.join(hot.select(*KEY), KEY, "left_anti").join(rest, KEY)
    row = ["doc_id", "t1", "t2"]
    lost = lines.join(hot, KEY).select(*row, "pos", "holder").unionByName(cold.select(*row, "pos", "holder"))
    lost = lost.filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    # Rows that repeat an id and a text lose the same lines, so a set of positions is right for each of them.
    dropped = lost.groupBy(*row).agg(F.collect_set("pos").alias("dropped")).select(
        F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "dropped"
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    cut = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("dropped"))
    left = F.array_join(F.transform(kept, lambda p: F.get(cut, p)), "\n")
    return whole.join(dropped, same, "left").select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(left).alias("kept_text"),
        F.size(cut).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
