"""What a job of this subpackage needs of its session and its workers; tables lie in the library's shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

from evidentia.sources.storage import clear, drop, fresh_path, shared_folder, written  # noqa: F401

#: Rows per Arrow batch: texts may be long, and a worker holds a whole batch.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts small. The setting is the session's and is read when a job is planned, so it
    stays: other queries of the session get batches of this size, too, and the same results."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_memory() -> None:
    """Gives a worker's freed memory back: workers are kept for later stages of other operators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trimmed(batches: Iterator) -> Iterator:
    """Batches one by one; what a worker freed while it worked on one is given back before the next."""
    for batch in batches:
        yield batch
        release_memory()
