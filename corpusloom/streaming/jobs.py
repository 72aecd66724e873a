"""Structured Streaming: windowed counts and a stateful job state machine over events."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.workflow import FOLLOWING


def source(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{folder}/events.parquet*")


def daily_counts(events: DataFrame) -> DataFrame:
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    return ts.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


STATES = ("pending", "parsing", "normalizing", "failed", "completed")


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, event_id, before, after, valid) for each event, with the job's state kept between batches.

    A transition that isn't allowed is reported and leaves the state as it is.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else None
        rows = []
        for pdf in frames:
            for event, ts in sorted(zip(pdf["event_id"], pdf["ts"], strict=True), key=lambda r: (r[1], r[0])):
                new = STATES[event % 5]
                valid = new == "pending" if now is None else new == now or new in FOLLOWING[now]
                rows.append((key[0], event, now, new, valid))
                now = new if valid else now
        if now is not None:
            state.update((now,))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "before", "after", "valid"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, before string, after string, valid boolean", "state string", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run over what there is now; the result as a table of files.  The output mode follows from the query's shape.

    Offsets, state and rows are kept under spark.checkpoint.dir (a temporary folder where none is set), so that a run survives its executors.
    """
    spark = stream.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    mode = "append" if "before" in stream.columns else "complete"

    def keep(rows: DataFrame, number: int) -> None:
        """A batch that is run again writes the same folder again."""
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number if mode == 'append' else 0}")

    running = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    empty = spark.createDataFrame([], stream.schema)
    if not running.lastProgress:
        return empty
    return spark.read.schema(stream.schema).parquet(f"{path}/rows").select(stream.columns)
