"""Whole files beside the rows that name them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from evidentia.sources.matrix import file_system_of


def with_files(rows: DataFrame, root: str, path_col: str, text_col: str = "text") -> DataFrame:
    """rows with the text of the file that path_col names below root, null where there is none; bytes that are no UTF-8 are replaced.

    A task opens the files of its own rows and no others, one at a time, so what rows leave out is never read.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system_of(root)
        for batch in batches:
            at = batch.schema.get_field_index(path_col)
            for i in range(batch.num_rows):
                row, path = batch.slice(i, 1), batch.column(at)[i].as_py()
                text = None
                if path is not None:
                    try:
                        with system.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as f:
                            text = f.read().decode("utf-8", "replace")
                    except FileNotFoundError:
                        pass
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([text], pa.string())], names=[*row.schema.names, text_col])

    return rows.mapInArrow(run, schema)
