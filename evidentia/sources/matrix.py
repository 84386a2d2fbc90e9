"""Raw float32 matrices as a data source: ranges of whole rows are read, and part files written, by tasks of their own.

A matrix is a file, or a folder whose files, in the order of their paths, follow each other. A folder that this source wrote lists its
parts in `_rows.json`, with the row that each begins at; what a failed attempt left is not in the list and is deleted on commit.
Files are reached by pyarrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "row_index long, vector array<float>"
NAME, LIST = "float_matrix", "_rows.json"
#: Bytes that a task reads, about, and rows of a batch.
PART_BYTES, BATCH_ROWS = 64 << 20, 4096


def file_system_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _parts(system: fs.FileSystem, at: str) -> list[tuple[str, int]]:
    """(path, bytes) of a matrix's files in order."""
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no matrix at {at}")
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    sizes = {f.path: f.size for f in found if f.type == fs.FileType.File}
    listed, loose = {}, []
    for name in sizes:
        if name.rsplit("/", 1)[-1] == LIST:
            with system.open_input_stream(name) as f:
                folder = name.rsplit("/", 1)[0]
                listed[folder] = [f"{folder}/{p['name']}" for p in json.loads(f.read())]
    for name in sizes:
        if name.rsplit("/", 1)[0] not in listed and not name.rsplit("/", 1)[-1].startswith(("_", ".")):
            loose.append((name, [name]))
    ordered = sorted([*loose, *listed.items()])
    return [(name, sizes[name]) for _, names in ordered for name in names]


@dataclass
class Rows(InputPartition):
    """Rows first to first + n of the matrix, which lie in a file from byte `start`."""

    path: str
    start: int
    first: int
    n: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])
        self.rows = max(1, int(options.get("partBytes", PART_BYTES)) // (4 * max(self.width, 1)))

    def partitions(self) -> list[Rows]:
        if self.width <= 0:
            raise ValueError("width must be positive")
        out, before = [], 0
        for name, size in _parts(*file_system_of(self.path)):
            if size % (4 * self.width):
                raise ValueError(f"{size} bytes are no whole rows of {self.width} float32 values")
            n = size // (4 * self.width)
            out += [Rows(name, 4 * self.width * at, before + at, min(self.rows, n - at)) for at in range(0, n, self.rows)]
            before += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        system, _ = file_system_of(self.path)
        with system.open_input_file(partition.path) as f:
            f.seek(partition.start)
            for at in range(0, partition.n, BATCH_ROWS):
                n = min(BATCH_ROWS, partition.n - at)
                values = np.frombuffer(f.read(4 * self.width * n), "<f4")
                if len(values) != n * self.width:
                    raise ValueError(f"{partition.path} has become shorter")
                ends = pa.array(np.arange(n + 1) * self.width, pa.int32())
                index = pa.array(np.arange(n) + partition.first + at, pa.int64())
                yield pa.RecordBatch.from_arrays([index, pa.ListArray.from_arrays(ends, pa.array(values))], names=["row_index", "vector"])


@dataclass
class Part(WriterCommitMessage):
    name: str
    first: int
    n: int


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options["width"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, at = file_system_of(self.path)
        system.create_dir(at, recursive=True)
        part, out = Part(f"part-{uuid.uuid4().hex}.f32", -1, 0), None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    part.first, out = batch.column("row_index")[0].as_py(), system.open_output_stream(f"{at}/{part.name}")
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
                if len(values) != batch.num_rows * self.width:
                    raise ValueError(f"a vector has not {self.width} components")
                out.write(values.astype("<f4").tobytes())
                part.n += batch.num_rows
        finally:
            if out is not None:
                out.close()
        return part

    def commit(self, messages: list[Part | None]) -> None:
        system, at = file_system_of(self.path)
        parts, rows = sorted((m for m in messages if m and m.n), key=lambda m: m.first), []
        for m in parts:
            rows.append({"name": m.name, "row": sum(r["rows"] for r in rows), "rows": m.n})
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at}/{LIST}") as f:
            f.write(json.dumps(rows).encode())
        self._delete(system, at, {m.name for m in parts})

    def abort(self, messages: list[Part | None]) -> None:
        """Files of an attempt that failed stay until the next commit; they are in no list."""

    @staticmethod
    def _delete(system: fs.FileSystem, at: str, but: set[str]) -> None:
        for f in system.get_file_info(fs.FileSelector(at)):
            if f.type == fs.FileType.File and f.base_name.startswith("part-") and f.base_name not in but:
                system.delete_file(f.path)


class FloatMatrix(DataSource):
    """spark.read.format("float_matrix").option("width", n).load(path), and the same to write."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def read_matrix(spark: SparkSession, path: str, width: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """(row_index, vector) of a matrix; a task reads about part_bytes. A size that is no multiple of a row's is an error."""
    Reader({"path": path, "width": width}).partitions()
    spark.dataSource.register(FloatMatrix)
    return spark.read.format(NAME).option("width", width).option("partBytes", part_bytes).load(path)


def write_matrix(vectors: DataFrame, path: str) -> tuple[int, int]:
    """The vectors by row_index as a folder of float32 rows, for tools that read no Parquet; (rows, width).

    No rows, no components and several widths are errors. Rows are dealt over tasks by ranges of row_index, and none passes the driver.
    """
    size = F.coalesce(F.size("vector"), F.lit(-1))
    facts = vectors.agg(F.count("*").alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi")).first()
    if not facts.n or facts.lo <= 0 or facts.lo != facts.hi:
        raise ValueError("no vectors" if not facts.n else f"vectors have {facts.lo} to {facts.hi} components")
    vectors.sparkSession.dataSource.register(FloatMatrix)
    rows = vectors.select(F.col("row_index").cast("long").alias("row_index"), F.col("vector").cast("array<float>").alias("vector"))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(tasks, "row_index").sortWithinPartitions("row_index").write.format(NAME).option("width", facts.lo).mode("append").save(path)
    return facts.n, facts.lo
