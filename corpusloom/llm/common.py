"""What the training-data operators share: tables, work folders, Arrow maps."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bounds of one Arrow batch sent to Python, so that long texts don't pile up.
BATCH_ROWS, BATCH_BYTES = 4000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which all executors share.

    Where the session names none (tests on one machine), a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, compression: str = "zstd", free: bool = False) -> DataFrame:
    """Write a table and read it again: cuts the lineage, survives lost executors.

    With ``free`` the shuffle files of finished steps, which nothing refers to any more, are let go at once.
    """
    spark, schema = df.sparkSession, df.schema
    df.write.option("compression", compression).parquet(path)
    if free:
        del df
        release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Collect garbage, on which Spark removes the shuffle files of what was collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, path: str) -> None:
    """Delete a work table that isn't needed any more, wherever it is stored."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(fn, schema)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    """A record batch from one list or array for each field."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checked_broadcast(df: DataFrame, rows: int, limit_rows: int) -> DataFrame:
    """Hint a broadcast only for a side whose counted rows stay under the limit."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if rows <= limit_rows else df
