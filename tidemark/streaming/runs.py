"""Stream sources and one-shot (availableNow) runs over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import fresh_path

EVENT_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


FILES_PER_BATCH = 64


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None, more: str | None = None) -> DataFrame:
    """Event files as a stream; ``ts`` becomes a zoned timestamp so that it can carry a watermark.

    A batch takes ``FILES_PER_BATCH`` files unless told otherwise, so that a backlog is worked
    off in bounded steps. ``more`` names further columns.
    """
    stream = (
        spark.readStream.schema(EVENT_SCHEMA + (f", {more}" if more else ""))
        .option("maxFilesPerTrigger", files_per_batch or FILES_PER_BATCH).parquet(path)
    )
    return stream.withColumn("ts", stream["ts"].cast("timestamp"))


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run the stream over what is available into a file sink."""
    run = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()


def drain_to_files(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is available into a file sink in the shared folder; return the result table."""
    out = fresh_path(spark, name)
    drain(stream, out, f"{out}-checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run the stream over what is available, each micro-batch through ``handle``."""
    run = (
        stream.writeStream.outputMode(mode).foreachBatch(handle)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()


def batch_writer(path: str):
    """Writer for one micro-batch that can be repeated: a retried batch overwrites its own folder."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
