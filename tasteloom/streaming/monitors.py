"""The hourly checks as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tasteloom.operators import monitor
from tasteloom.session import new_path

LATENESS = "1 hour"


def read_events(spark: SparkSession, path: str, schema: StructType, ts: str = "ts",
                files_per_batch: int | None = None, lateness: str = LATENESS) -> DataFrame:
    """A stream of the Parquet files in the folder `path`, or of that one file, with a watermark on `ts`.

    Watermarks need a timestamp with time zone, so a zone-less column is read as UTC. A path without
    any file is an error, not an empty stream.
    """
    path = path.rstrip("/")
    parent, _, name = path.rpartition("/")
    present = spark.read.schema(schema).parquet(path).inputFiles()
    if not present:
        raise FileNotFoundError(f"no files in {path}")
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if len(present) == 1 and present[0].rpartition("/")[2] == name:  # streams open folders only
        reader, path = reader.option("pathGlobFilter", name), parent
    return reader.parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def start(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append closed windows to Parquet: continuously, or once over what is there."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_available(stream: DataFrame, tag: str, timeout: int | None = None) -> DataFrame:
    """Process everything that is available now and return the rows that were appended.

    It takes as long as it takes, unless a `timeout` in seconds is given.
    """
    spark = stream.sparkSession
    path = new_path(spark, tag)
    query = start(stream, path, new_path(spark, f"{tag}-state"))
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"{tag} did not finish in {timeout} s")
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(path)


def data_quality(events: DataFrame, constraints: DataFrame, ts: str = "ts", width: str = "1 hour",
                 preprocess: Callable[[DataFrame], DataFrame] | None = None,
                 postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    return monitor.data_quality(events, constraints, ts, width, preprocess, postprocess)


def model_quality(predictions: DataFrame, truth: DataFrame, key: str, metrics: list[Column],
                  ts: str = "ts", width: str = "1 hour",
                  preprocess: Callable[[DataFrame], DataFrame] | None = None,
                  postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Stream of predictions with a static table of truths."""
    return monitor.model_quality(predictions.join(truth, key), ts, metrics, width, preprocess, postprocess)


def model_quality_two_streams(predictions: DataFrame, truths: DataFrame, key: str, truth_ts: str,
                              metrics: list[Column], ts: str = "ts", delay: str = "1 hour",
                              width: str = "1 hour", preprocess: Callable[[DataFrame], DataFrame] | None = None,
                              postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Predictions and truths both arrive as streams.

    A truth counts when it arrives within `delay` after its prediction; that bound and the two
    watermarks are what let Spark drop old join state. `truths` has columns key, truth_ts, ...
    """
    right = truths.withColumnRenamed(key, "_truth_key")
    in_time = ((F.col(key) == F.col("_truth_key")) & (F.col(truth_ts) >= F.col(ts))
               & (F.col(truth_ts) <= F.col(ts) + F.expr(f"interval {delay}")))
    return monitor.model_quality(predictions.join(right, in_time), ts, metrics, width, preprocess, postprocess)


def model_breaches(predictions: DataFrame, truth: DataFrame, key: str, metrics: list[Column], bounds: DataFrame,
                   ts: str = "ts", width: str = "1 hour") -> DataFrame:
    """Metrics of closed windows that lie beyond their bounds."""
    return monitor.metric_breaches(model_quality(predictions, truth, key, metrics, ts, width), bounds)


def operations(events: DataFrame, is_error: Column, latency: str, ts: str = "ts",
               width: str = "1 hour") -> DataFrame:
    return monitor.operations(events, ts, is_error, latency, width)
