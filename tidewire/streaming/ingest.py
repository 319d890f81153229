"""Incremental ingest and counters with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.merge import insert_new


def ingest_new(stream: DataFrame, target: str, checkpoint: str, *, keys: list[str], order: str) -> StreamingQuery:
    """Appends each micro-batch's rows whose key the target lacks; a batch that is run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(target)
            batch = insert_new(known, batch, keys, order)
        except Exception as missing:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            batch = batch.dropDuplicates(keys)
        batch.write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, time: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and key, with a watermark for late rows."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def lease_states(events: DataFrame) -> DataFrame:
    """Latest status and attempts of each job from a stream of (job_id, at, status) events."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, status, attempts = state.get if state.exists else (0.0, "", 0)
        for frame in frames:
            for row in frame.sort_values("at").itertuples():
                attempts += row.status == "running"
                if row.at >= at:
                    at, status = float(row.at), row.status
        state.update((at, status, int(attempts)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "attempts": [int(attempts)]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, attempts int", "at double, status string, attempts int", "update", GroupStateTimeout.NoTimeout)


def events_by_day(spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """Streams the events table once and returns daily counts by type."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(folder)
    name = "events_by_day"
    counts = windowed_counts(stream, time="ts", by="event_type")
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
