"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of ``BLOCK`` bytes. The distinct blocks are sorted and numbered; then adjacent pairs of
names are named in the same way, round after round, until one name is left per document. Two documents with
the same number of blocks have the same last name exactly if their texts are equal: names stand for contents, not for hashes.

Block contents are shuffled once, after duplicates were dropped where they were read, so a block that a third of all rows share
arrives once per map task. Blocks meet their names by a 128-bit key; keys that two contents share are counted, and if there are
any, naming starts again with other keys. All later rounds move (row, position, name) only.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialise, text_or_empty
from kindred.operators.scale_out import broadcast_if_small

BLOCK = 4096


def normalised(text: Column) -> Column:
    """Every run of ASCII white space becomes one space (single spaces already are one)."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def block_keys(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), block).alias("k1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("k2")]


def _blocks(text: Column, size: int) -> Column:
    data = text.cast("binary")
    last = F.floor((F.greatest(F.octet_length(text), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, sort_by: list[str], name: str = "name") -> DataFrame:
    """Numbers distinct rows; sorted, so that a repeated task gives the same numbers."""
    return distinct.sortWithinPartitions(*sort_by).withColumn(name, F.monotonically_increasing_id())


def block_names(
    docs: DataFrame, text: Column, size: int, keys: Callable[[Column, int], list[Column]]
) -> tuple[DataFrame, int]:
    """(``k1, k2, name`` of every distinct block, the seed whose keys tell all blocks apart)."""
    for seed in count():
        blocks = docs.select(F.explode(_blocks(text, size)).alias("block")).select(*keys(F.col("block"), seed), "block")
        named = _named(blocks.dropDuplicates(["k1", "k2", "block"]), ["k1", "k2", "block"]).drop("block")
        names = materialise(named.groupBy("k1", "k2").agg(F.min("name").alias("name"), F.count("*").alias("n")), "names")
        if names.filter("n > 1").isEmpty():
            return names.drop("n"), seed
    raise AssertionError


def identities(
    docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK,
    keys: Callable[[Column, int], list[Column]] = block_keys,
) -> DataFrame:
    """One row per input row: ``doc_id, row, n_blocks, name, text_sha256``; texts are equal if ``(n_blocks, name)`` are."""
    source = docs.select(F.col(id).cast("long").alias("doc_id"), normalised(text_or_empty(text)).alias("text"))
    names, seed = block_names(source, F.col("text"), size, keys)
    cut = source.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("sha"),
        F.transform(_blocks(F.col("text"), size), lambda b: F.struct(*keys(b, seed))).alias("blocks"),
    ).select("row", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    first = F.col("pos") == 0
    cut = cut.select(
        "row", F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("sha"), "n", "pos", "block.*"
    )
    # The written table fixes the row numbers; from here on nothing reads the texts.
    level = materialise(cut, "blocks").join(names, ["k1", "k2"]).drop("k1", "k2").withColumn("blocks", F.col("n"))
    level = materialise(level, "named")
    longest = level.agg(F.max("n")).first()[0] or 1
    done = [level.filter("n = 1")]
    while longest > 1:
        longest = (longest + 1) // 2
        half = F.floor(F.col("pos") / 2).cast("int").alias("pos")
        pairs = level.filter("n > 1").groupBy("row", half).agg(
            F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("blocks").alias("blocks"),
            F.floor((F.max("n") + 1) / 2).cast("int").alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = materialise(pairs, "pairs")
        names = materialise(_named(pairs.select("left", "right").distinct(), ["left", "right"]), "names")
        level = materialise(pairs.join(names, ["left", "right"]).drop("left", "right"), "named")
        done.append(level.filter("n = 1"))
    whole = done[0].select("doc_id", "row", "blocks", "name", "sha")
    for part in done[1:]:
        whole = whole.unionByName(part.select("doc_id", "row", "blocks", "name", "sha"))
    return whole.select("doc_id", "row", F.col("blocks").alias("n_blocks"), "name", F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK, **options) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Equal are texts that are identical after normalising white space; null counts as empty. ``keep_id`` is the smallest id of
    the group. Of rows that repeat an id and a text one is kept, and all count in ``group_size``. A null id comes after
    all others: ``keep_id`` is null if the whole group has null ids. Other columns are not read. An empty table gives no rows.
    """
    rows = materialise(identities(docs, id, text, size, **options), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    groups = materialise(
        rows.groupBy("n_blocks", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups"
    ).select("n_blocks", "name", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
    return rows.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256"
    )


def keep_distinct(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    rows = exact_dedup(docs, id, text, **options)
    per_id = materialise(rows.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "kept")
    # Texts stay where they are unless the ids to drop are too many to broadcast.
    dropped = broadcast_if_small(per_id.filter("not kept").select("doc_id", "text_sha256"), max_rows=200_000)
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(*columns, F.col(id).cast("long").alias("_id"), F.sha2(normalised(text_or_empty(text)), 256).alias("_sha"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256"))
    found = marked.join(dropped, same, "left_anti")
    repeated = per_id.filter("kept and n > 1").select("doc_id", "text_sha256")
    if not repeated.isEmpty():  # of rows that repeat an id and a text one is kept
        found = found.join(repeated, same, "left_anti").unionByName(
            found.join(repeated, same, "left_semi").dropDuplicates(["_id", "_sha"])
        )
    return found.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
