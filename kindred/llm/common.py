"""What the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from kindred.operators.scale_out import materialise

__all__ = ["bucket_of", "latin", "materialise", "only_cache", "parts_of", "table", "text_or_empty", "via_arrow"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def via_arrow(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: pa.Schema | StructType
) -> DataFrame:
    """Apply ``work`` to every Arrow batch of ``df``; batches for which it returns ``None`` give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = work(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema if isinstance(schema, StructType) else from_arrow_schema(schema))


def parts_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the batches, in parts of about ``size`` bytes; a longer text is a part of its own."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, text in zip(batch["doc_id"], batch["text"]):
            n = text.as_buffer().size
            if texts and held + n > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(i.as_py())
            texts.append(text.as_py())
            held += n
    if texts:
        yield ids, texts


_caches: dict[str, Callable[[], None]] = {}


def only_cache(owner: str, drop: Callable[[], None]) -> None:
    """Called by an operator before it fills its cache: Python workers live on from one operator to the next, so what
    another one has cached is dropped."""
    if owner not in _caches:
        for other in _caches.values():
            other()
        _caches.clear()
        _caches[owner] = drop
        give_back()


def give_back() -> None:
    """Returns what this process has freed to the system: else each worker keeps the most that any operator took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def bucket_of(columns: Sequence[str], n: int) -> Column:
    """A number below ``n`` that depends on the values only, so a repeated task deals rows alike."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def latin(text: str) -> bool:
    """Whether all characters are below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True
