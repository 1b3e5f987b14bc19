"""What several operators of this subpackage need: shared storage, batch mapping, folds, digests."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.sources.scratch import forget, shared_path, written

__all__ = ["SLICE_BYTES", "WORD", "fold", "forget", "give_back", "map_batches", "named", "shared_path", "slices", "spread", "table", "texts_of", "with_fields", "written"]

#: Arrow batches are cut to about this many bytes before Python works on them.
SLICE_BYTES = 8 << 20

#: A word in the sense of the size and shingle contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes than this is dealt out over all cores if it comes in fewer pieces than they are.
SMALL_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """df in a piece or more for each core where it is small: a small file is often one row group, and that one task.

    Larger tables have row groups enough and are not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < SMALL_BYTES and df.rdd.getNumPartitions() < 2 * cores else df


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about limit bytes each, one row at least."""
    rows = batch.num_rows
    step = max(1, min(rows, rows * limit // max(batch.nbytes, 1))) if rows else 1
    for at in range(0, rows, step):
        yield batch.slice(at, step)


#: Rows of a batch for Python where the session has not set a number of its own: a row may be a whole document.
ROWS, USUAL = "1000", "10000"


def small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == USUAL:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for a while after a task, next to those of other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over small slices; make() runs once a task and gives the function of a slice."""

    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    own, names, plain_names = df.columns, schema.names, [f"c{k}" for k in range(max(len(df.columns), len(schema.names)))]
    # Spark looks the columns of its input up by name, which fails for some; they get plain names for the call
    odd = any(c in name for name in own for c in "`.")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch.rename_columns(own) if odd else batch, limit):
                found = work(part)
                yield found.rename_columns(plain_names[: len(names)]) if odd else found
        work = batch = part = found = None
        give_back()

    small_batches(df)
    if not odd:
        return df.mapInArrow(run, schema)
    plain = StructType([StructField(n, f.dataType) for n, f in zip(plain_names, schema.fields, strict=False)])
    return df.toDF(*plain_names[: len(own)]).mapInArrow(run, plain).toDF(*names)


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def with_fields(kept: list[StructField], more: str) -> StructType:
    """Fields of any names and types, and more of the names and types that a text states."""
    return StructType([*kept, *StructType.fromDDL(more).fields])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(0))
