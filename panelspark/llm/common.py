"""Shared helpers: the shared folder, written intermediate tables and Arrow batches of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark import storage
from panelspark.llm.hashing import BATCH
from panelspark.storage import drop_table as drop_table

_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is run inside; the session's own setting holds again afterwards."""
    own = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_ROWS, own)


def files_for(spark: SparkSession, rows: int, each: int) -> int:
    """Files for so many rows, about ``each`` in one, and no more than a shuffle has partitions: a small table in as many
    files as a large one costs more to write and to read than to make."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)))


def materialize(df: DataFrame, name: str, rows: int = 1000, files: int | None = None) -> DataFrame:
    """An intermediate table (see ``storage``), written in Arrow batches of so many rows and in at most so many files;
    afterwards the shuffle files of what made it may go."""
    with batch_rows(df.sparkSession, rows):
        out = storage.materialize(df if files is None else df.coalesce(files), name)
    storage.collect_garbage(df.sparkSession)
    return out


def buckets(spark: SparkSession, times: int = 4) -> int:
    """Hash buckets for packed keys: they follow the configured shuffle width, which follows the input."""
    return max(8, times * int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives freed memory back to the system when its task ends: Python workers live on, and an executor
    has several."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return then


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, for functions that make Python objects or wide arrays of a whole batch.
    A result that the caller writes comes in the session's own batches, of which Spark bounds the bytes."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """(_id, _th, _text) and, if wanted, _rest, a struct of the row's columns but the text. A row's key is its id and its text's hash, so that null or repeated ids do no harm;
    rows equal in both are the same document twice and have the same result. Other columns are left."""
    text = F.col(text_col).cast("string")
    more = [F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("_rest")] if rest else []
    return docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"), *more)


def mapped(docs: DataFrame, text_col: str, fn: Callable[[pa.Array], list[pa.Array]], new: list[T.StructField], rows: int = 1000) -> DataFrame:
    """All columns of docs and the new ones, made by ``fn`` from so many texts at a time; the text is sent once.
    Where docs has a column of a new one's name, the new one takes its place."""
    nested = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    plain = isinstance(docs.schema[text_col].dataType, T.StringType)
    if not plain:
        nested = nested.withColumn("_text", F.col("_row").getField(text_col).cast("string"))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            row = batch.column("_row")
            text = row.flatten()[place] if plain else batch.column("_text")
            yield pa.RecordBatch.from_arrays([row, *fn(text)], ["_row", *(f.name for f in new)])

    out = nested.mapInArrow(tidied(run), T.StructType([nested.schema["_row"], *new]))
    names = [f.name for f in new]
    return out.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c not in names), *names)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and each row's bounds in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def groups_of(bounds: np.ndarray, most: int = BATCH) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


def packed(arrays: list[np.ndarray], kind: str) -> bytes:
    return np.concatenate(arrays).astype(kind).tobytes() if arrays else b""
