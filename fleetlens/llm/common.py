"""What the operators share: table access, kept steps, word patterns, state of a Python worker."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.session import shared_folder

#: Bytes that part words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch that are worked on at a time, so that lists of words stay small.
ROWS_AT_ONCE = 256
TEXT_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows of ``df``, computed now and kept as a table in the folder that executors share.

    Shuffle files of the job go when it is done, since later reads need the table only.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, purpose), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Deletes a table that :func:`stored` made, once nothing will read it any more."""
    spark = kept.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def bucket(doc_id: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets


def give_back() -> None:
    """Returns freed memory to the system: a Python worker waits for its next task beside others at work."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        give_back()


def text_slices(
    batches: Iterator[pa.RecordBatch], column: int, rows: int, size: int = TEXT_BYTES
) -> Iterator[pa.RecordBatch]:
    """At most ``rows`` rows and about ``size`` bytes of text at a time; a longer text comes alone."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = int(np.searchsorted(ends, before + size, "right"))
            end = min(max(end, start + 1), start + rows)
            yield batch.slice(start, end - start)
            start = end
        del batch, lengths
        give_back()


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """Something costly to make, kept by the Python worker (not pickled) while it is in use.

    Workers go on to other jobs, so only the last one that was asked for is kept, and an earlier one
    goes before the next is made.
    """
    if key not in sys.__dict__.get("_fleetlens_llm_state", {}):
        drop_states()
        sys.__dict__["_fleetlens_llm_state"] = {key: make()}
    return sys.__dict__["_fleetlens_llm_state"][key]


def drop_states() -> None:
    """Gives up what :func:`worker_state` kept, in a job that needs none of it."""
    if "_fleetlens_llm_state" in sys.__dict__:
        del sys.__dict__["_fleetlens_llm_state"]
        gc.collect()
        give_back()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
