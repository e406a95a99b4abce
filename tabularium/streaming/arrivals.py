"""Rows of block files that arrive in a folder: whole files from a stream, decoded by the same layout and codecs.

Also the way to read files from any stream of bytes: decoded_files takes a DataFrame of paths or contents, as binaryFile gives.
A file is one task's work, so this suits many small files; a large table is better read by the data source, which splits it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..runtime import ship
from ..sources import codec, files
from ..sources import layout as L


def stream_rows(stream: Any, charset: str = "cp1252", at_once: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """All rows of a data file given as a stream of bytes, read once from start to end, a few MB at a time; blobs, which lie in another file, are NULL."""
    start = stream.read(4)
    header = L.parse(start + stream.read(max(0, L.header_length(start) - 4)))
    if header.encryption:
        raise L.TableError("the file is encrypted")
    step = max(1, at_once // max(1, header.block_size))
    for low in range(0, header.file_blocks, step):
        want = (min(header.file_blocks, low + step) - low) * header.block_size
        data = stream.read(want)
        if len(data) < want:
            raise L.TableError("the file ends within a block")
        n, view = files.rows_of(header, np.frombuffer(data, np.uint8).reshape(-1, header.block_size))
        rows = view[np.arange(view.shape[1]) < n[:, None]]
        yield pa.RecordBatch.from_arrays([codec.decode(f, rows, charset) for f in header.fields], [f.name for f in header.fields])


def decoded_files(found: DataFrame, schema: str, charset: str = "cp1252") -> DataFrame:
    """Rows of all data files found, batch or stream: of each content if there is such a column, else of the file at each path.

    schema names the columns all files have. A file's bytes go through one task; those of a path are never held as a whole.
    """
    ship(found.sparkSession)
    whole = "content" in found.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if whole:
                    yield from stream_rows(pa.BufferReader(value.as_buffer()), charset)
                    continue
                path = re.sub("^file:/+", "/", value.as_py())  # as Spark names it: not escaped
                fs, plain = (pafs.LocalFileSystem(), path) if path.startswith("/") else files.opened(path)
                with fs.open_input_stream(plain) as stream:
                    yield from stream_rows(stream, charset)

    return found.select("content" if whole else "path").mapInArrow(read, schema)


def arriving(spark: SparkSession, directory: str, schema: str, charset: str = "cp1252") -> DataFrame:
    """A stream of the rows of each .db file that appears in a folder."""
    binary = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(binary).option("pathGlobFilter", "*.[dD][bB]").load(directory)
    return decoded_files(stream, schema, charset)
