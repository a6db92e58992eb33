"""Shared plumbing: tables, words, and Arrow batch helpers; storage on the cluster's shared folder comes from the session module."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.session import discard, scratch_path, ship, stored

__all__ = ["discard", "group_arrow", "let", "map_arrow", "offset_type", "scratch_path", "ship", "slices", "stored", "table", "text_bytes", "trim", "words_of"]

#: Separators of words: the six ASCII white-space characters.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and hand it to body as a bound variable (a lambda argument cannot be inlined by the optimizer)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a whole text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


# ---------------------------------------------------------------- Python on executors


def trim() -> None:
    """Give memory that is free in this worker back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        trim()

    return df.mapInArrow(whole, schema)


def group_arrow(df: DataFrame, keys: Sequence[str], task: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """One call of task for each group of rows; memory is given back after each."""
    ship(df.sparkSession)

    def whole(group: pa.Table) -> pa.Table:
        out = task(group)
        trim()
        return out

    return df.groupBy(*keys).applyInArrow(whole, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the string column holds about most_bytes at a time; one longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        ends = np.frombuffer(texts.buffers()[1], offset_type(texts))[texts.offset : texts.offset + len(texts) + 1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def offset_type(texts: pa.Array):
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    return np.int64 if wide else np.int32


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after another, and the n + 1 bounds; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    bounds = np.frombuffer(texts.buffers()[1], offset_type(texts))[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]
