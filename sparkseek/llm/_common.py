"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.store import cut, drop, scratch, shared_dir
from ..plans.views import table

__all__ = ["cut", "drop", "labelled", "partitions", "raw", "scratch", "shared_dir", "slices", "table", "tidy"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text each, so that Python's copies stay small."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = sizes.cumsum()
    start, floor = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(ends.searchsorted(floor + most, "right")))
        yield batch.slice(start, end - start)
        start, floor = end, int(ends[end - 1])


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system: workers wait for their next task, and others share the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only some C libraries have it
        pass


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; null: empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def labelled(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text), one row for each id of chosen (id, y; a bounded sample) that docs has: of several texts that with the smallest hash."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("id", "y", "x.text")
