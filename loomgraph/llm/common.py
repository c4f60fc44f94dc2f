"""Session and Arrow helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import cut, shared_dir

__all__ = ["aside", "cut", "gone_at_exit", "mapped", "packed", "partitions_for", "remove", "shared_dir", "spread", "steps", "table"]

#: Bytes of text that one numpy step works on; bounds a Python worker's memory whatever the Arrow batch holds.
STEP_BYTES = 1 << 20
#: Rows in an Arrow batch, of texts of any length; the session's own setting holds where it is smaller.
BATCH_ROWS = 1000
#: Bytes of input below which rows are dealt out to all cores first: such a table may be one row group, so one task.
SMALL_BYTES = 20 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(df: DataFrame, *core: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df whose columns other than `core` have names that no operator uses, and what gives a result with all of df's columns their names back."""
    columns = df.columns
    plain = [c if c in core else f"__{i}__" for i, c in enumerate(columns)]
    return df.toDF(*plain), lambda out: out.select(*plain).toDF(*columns)


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out to all cores if it is small; a large table's scan has tasks enough, and isn't shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-size // (1 << 17))))) if size < SMALL_BYTES else df


def mapped(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(), in batches of few rows; a Python worker gives its free memory back to the system after each task."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for n, out in enumerate(function(batches)):
                yield out
                if n % 16 == 15:
                    pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that a lazy result still reads deleted when the session ends."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and each row's offset (one more than rows); a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose `column` holds about `limit` bytes; a longer row comes alone, whole."""
    if batch.num_rows == 0:
        return
    _, off = packed(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
