"""Rows packed into compressed blocks, so that texts move once and in few records.

A block is a zstd-compressed Arrow stream of some MB of rows in ascending id
order. An operator that must come back to a text after a global step asks its
question per block and gets the answer per block, not per word or document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = "block long, payload binary"
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(payload) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about `most` bytes from consecutive batches."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack(df: DataFrame, order: str, most: int, tasks: int) -> DataFrame:
    """df as (block, payload), dealt by block over as many tasks.

    Rows of a block are in the order of the column `order`, nulls first. A block's number
    is a digest of its payload: a task that runs again makes the same blocks from the same rows,
    and what was asked about a block can never be answered to one of other rows.
    """

    def run(batches):
        for table in packed(batches, most):
            table = table.take(pc.sort_indices(table, sort_keys=[(order, "ascending")], null_placement="at_start"))
            payload = packed_table(table)
            number = int.from_bytes(hashlib.blake2b(payload, digest_size=8).digest(), "little", signed=True)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "payload": pa.array([payload], pa.binary())})

    return df.mapInArrow(run, BLOCK_SCHEMA).repartition(tasks, "block")


def unanswered(block: int) -> Exception:
    return RuntimeError(f"block {block} holds other rows than when it was asked about: the input changed; write it to a table first")
