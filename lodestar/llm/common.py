"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where
    the session names none, a folder of this machine if Spark runs in this
    process alone; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def persist(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back. This cuts the lineage
    and, unlike a cache, outlives the executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(*made: DataFrame) -> None:
    """Deletes what persist wrote, once nothing reads it any more."""
    for df in made:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release(spark: SparkSession) -> None:
    """Has Spark notice shuffles that nothing refers to any more, whose files it then deletes;
    it would do so at the driver's next full collection."""
    for _ in range(2):  # the last query's events may still be under way
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Has Spark send batches of so many rows to Python, if the session says nothing
    else: ten thousand long texts, twice a task, are more than an executor has room for."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, rows)


def modest_bytes(spark: SparkSession, size: int = 16_000_000) -> None:
    """Has Spark send batches of so many bytes to Python, if the session says nothing else: a group of
    packed values would be one batch, whose buffer outside the heap doubles until it fits."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name).rstrip("b") == "2147483647":  # the default
        spark.conf.set(name, size)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def raw_text(column: str = "text"):
    """The text's UTF-8 bytes; none for a null."""
    return text_or_empty(column).cast("binary")


def groups(values: list, limit: int):
    """Slices of values of about limit bytes or characters each."""
    start = size = 0
    for i, value in enumerate(values):
        size += len(value)
        if size >= limit:
            yield start, values[start : i + 1]
            start, size = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def parts(column: pa.Array, limit: int):
    """A column of texts in slices of about limit bytes, each with its first row's number."""
    total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        base = total[start - 1] if start else 0
        end = min(int(np.searchsorted(total, base + limit)) + 1, len(column))
        yield start, column.slice(start, end - start)
        start = end


def slices(column: pa.Array, limit: int):
    """The bytes of a column of texts (null: none) in lists of about limit bytes,
    each with its first row's number; only one list exists at a time."""
    for start, part in parts(column, limit):
        yield start, [x or b"" for x in part.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; for a written table its files know the number."""
    return df.count() <= rows if rows else df.isEmpty()
