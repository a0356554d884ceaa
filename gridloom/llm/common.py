"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import graphs

#: Share of documents (crc32 of the id as text, modulo) that no classifier learns labels from.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark only, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents whose labels are never learnt from (a null id counts as held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; fails on a cluster where it is unset."""
    return graphs.shared_path(spark, name)


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_in_small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Whole texts reach Python ``rows`` at a time in this session from here on, for what is computed only after its step has returned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    spark.conf.set(name, str(rows if before <= 0 else min(rows, before)))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs run here hand whole texts to Python ``rows`` at a time: Spark's 10,000 rows of long texts stand twice, in the JVM and in the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    texts_in_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def released(spark: SparkSession) -> None:
    """Asks for the driver's garbage to be collected: only then does Spark delete the shuffle files of jobs whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts_of(batch: pa.RecordBatch, column: str, most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of the text or list ``column`` in each; a longer value is alone in its slice."""
    values = batch.column(column)
    long = pc.list_value_length if pa.types.is_list(values.type) or pa.types.is_large_list(values.type) else pc.binary_length
    ends = np.cumsum(pc.fill_null(long(values), 0).to_numpy().astype(np.int64) * (1 if long is pc.binary_length else 4))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def stable_hash(data: bytes, seed: int = 0) -> int:
    return zlib.crc32(data, seed)
