"""What the operators of this subpackage share: tables, bounded batches and texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, shared_dir

__all__ = ["BATCH_BYTES", "discard", "id_text", "in_tasks", "materialise", "release", "shared_dir", "slices", "table", "texts"]

#: Text bytes that a Python worker handles at a time; a longer text makes a batch of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives memory that a worker has freed back to the system: workers are kept for later tasks, and their number adds up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of `column` at most, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    release()


def in_tasks(df: DataFrame) -> DataFrame:
    """df, for joins that neither side is broadcast in. Spark takes Python's output for as many rows as the input, and a written
    table for as large as its file, however well its columns compress; a broadcast that it so takes for small is built on the driver."""
    return df.hint("merge")


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; a null text is empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def id_text(column: str = "doc_id"):
    """doc_id as text; a null id is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
