"""Shared plumbing of the training-data operators: shared storage, safe column names, Arrow row maps."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Used only where the session names no shared folder and runs in one process (tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quire"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all run in one process, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    held = None if found else spark.sparkContext.getCheckpointDir()
    if held:
        found = held.rsplit("/", 1)[0]
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quire/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *, codec: str = "snappy") -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder; a lost executor costs no recomputation behind it."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no frame has a column of that name (names compare without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def append_arrow(df: DataFrame, inputs: list[str], name: str, kind: T.DataType, make: Callable[[], Callable[..., pa.Array]]) -> DataFrame:
    """df and one more column, computed batch by batch. make() runs once in each task and returns a function of the input arrays.

    Batches are cut to about 2 MB of the first input, so that a run of very long texts stays small in memory.
    """
    where = [df.columns.index(c) for c in inputs]
    made = to_arrow_type(kind)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for whole in batches:
            for batch in cut(whole, where[0]):
                out = apply(*(batch.column(i) for i in where))
                out = out if isinstance(out, pa.Array) and out.type == made else pa.array(out, type=made)
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def cut(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes together (one row at least)."""
    size = batch.column(column).nbytes
    if size <= most or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    yield from cut(batch.slice(0, half), column, most)
    yield from cut(batch.slice(half), column, most)


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start to start + size - 1 of all runs, one run after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
