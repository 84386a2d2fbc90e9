"""Intermediate tables in the folder that the driver and all executors share.

All tables of a session lie in one folder. drop() deletes one that is no longer read, clear() all
of them; what is left goes when the driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_leaving: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a folder of our own only where none is set and driver and executors are one machine."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/evidentia-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    folder = session_folder(spark)
    if folder not in _leaving:
        _leaving.add(folder)
        atexit.register(_left, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, with its lineage cut: its rows are computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    return written(df, "kept")


#: Tables of at most so many bytes are dealt out by spread().
SPREAD_BYTES, SPREAD_FILES = 64 << 20, 64


def spread(df: DataFrame) -> DataFrame:
    """df dealt over as many partitions as shuffles have, where it reads a small table that lies in few row groups and would occupy few
    cores; a larger one is returned as it is, since moving it would cost more than it gains."""
    files = df.inputFiles()
    if not 0 < len(files) <= SPREAD_FILES:
        return df
    size = 0
    for name in files:
        system, at = file_system(df.sparkSession, name)
        size += system.getFileStatus(at).getLen()
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if size <= SPREAD_BYTES else df


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path in it)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _delete(spark: SparkSession, path: str) -> None:
    files, at = file_system(spark, path)
    files.delete(at, True)


def drop(table: DataFrame) -> None:
    """Deletes the files of a written() table that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if f"/evidentia-{spark.sparkContext.applicationId}/" in path:
            _delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of this session; DataFrames that read them end."""
    _delete(spark, session_folder(spark))


def _left(spark: SparkSession, folder: str) -> None:
    if SparkContext._active_spark_context is spark.sparkContext:  # still there
        _delete(spark, folder)
