"""What several operators share: the checkpoint folder, text as words, digests."""

from __future__ import annotations

import ctypes
import tempfile
from functools import wraps
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of texts that go to a Python worker at once, at most.
BATCH_ROWS = 2048


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's spark.checkpoint.dir, or, where that is unset and Spark runs in this process alone, one of its own."""
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder; a lost executor doesn't lose it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared checkpoint folder, of which readers take the columns they need."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands no more rows to a Python worker at once: texts of a batch are in memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that of it."""
    return df.limit(rows + 1).count() <= rows


def tidy(run):
    """A task's function over batches that hands freed memory back when it ends: the worker stays, and another may run beside it."""

    @wraps(run)
    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return tidied


def slices(batch, column: int, most: int):
    """A record batch in pieces of about so many bytes of one column, and of one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
