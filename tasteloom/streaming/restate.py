"""Model quality per window when the truth arrives after the window was closed.

A streamed aggregate drops what comes behind its watermark. Here every batch of truths is joined with the
table of predictions and leaves its windows' partial sums in a folder of its own; a window's metrics are
the sums over all batches. A batch that is repeated after a failure replaces its folder, so each truth
counts exactly once, however late it is, and there is no state that grows with the stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tasteloom.functions.scalars import abs_error, squared_error
from tasteloom.session import hadoop_path
from tasteloom.sources import versions

SUMS = ("window_start timestamp, n long, abs_sum double, square_sum double, label_sum double, label_gap_sum double, "
        "tp long, fp long, fn long, tn long")
NAMES = [part.split()[0] for part in SUMS.split(", ")][1:]


def window_sums(scored: DataFrame, ts: str = "ts", width: str = "1 hour", prediction: str = "prediction",
                label: str = "label", predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """The sums of `NAMES` per window: everything the metrics need. All but `label_gap_sum`, the squared gaps of the
    labels to their mean, merge by addition; `_total` adds to that what lies between the batches' means."""
    label_value = F.col(label).cast("double")
    hits = [F.count_if((F.col(predicted) == p) & (F.col(actual) == a)) for p, a in ((1, 1), (1, 0), (0, 1), (0, 0))]
    sums = [F.count(F.lit(1)), F.sum(abs_error(prediction, label)), F.sum(squared_error(prediction, label)),
            F.sum(label_value), F.var_pop(label_value) * F.count(label_value), *hits]
    return (scored.groupBy(F.window(F.col(ts).cast("timestamp"), width)["start"].alias("window_start"))
            .agg(*[c.alias(n) for c, n in zip(sums, NAMES)]))


def restate(truths: DataFrame, predictions: DataFrame, key: str, place: str, checkpoint: str, ts: str = "ts",
            width: str = "1 hour", every: str | None = None) -> StreamingQuery:
    """Start adding the streamed `truths` (key, label, actual) to the windows of their predictions.

    `predictions` (key, ts, prediction, predicted) is read anew with every batch. A truth whose prediction
    is not in the table counts nowhere; one that is sent twice counts twice. A store belongs to one
    checkpoint, whose batch numbers name its folders. Runs over what is there, or continuously with `every`.
    """
    place = place.rstrip("/")

    def add(batch: DataFrame, number: int) -> None:
        scored = predictions.join(batch, key)
        window_sums(scored, ts, width).write.mode("overwrite").parquet(f"{place}/batch={number}")

    writer = truths.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _batches(spark: SparkSession, place: str, after: int) -> list[int]:
    """Complete batches behind `after`: a folder being written, or replaced, has no _SUCCESS yet."""
    system, folder = hadoop_path(spark, place)
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    numbers = sorted(int(n[6:]) for n in names if n.startswith("batch="))
    return [n for n in numbers if n > after and system.exists(hadoop_path(spark, f"{place}/batch={n}/_SUCCESS")[1])]


def _total(spark: SparkSession, place: str, state: versions.Version | None, batches: list[int]) -> DataFrame:
    paths = [f"{place}/batch={n}" for n in batches] + ([state.value["sums"]] if state else [])
    found = spark.read.schema(SUMS).parquet(*paths) if paths else spark.createDataFrame([], SUMS)
    window = Window.partitionBy("window_start")  # a row per batch that brought truths for it
    gap = F.col("label_sum") / F.col("n") - F.sum("label_sum").over(window) / F.sum("n").over(window)
    found = found.withColumn("label_gap_sum", F.col("label_gap_sum") + F.col("n") * gap * gap)
    return found.groupBy("window_start").agg(*[F.sum(n).alias(n) for n in NAMES])


def fold(spark: SparkSession, place: str) -> None:
    """Add up all batches but the last, which may still be repeated, into one folder that takes their place."""
    place = place.rstrip("/")
    state = versions.current(spark, f"{place}/_folded")
    through = state.value["through"] if state else -1
    old = _batches(spark, place, through)[:-1]
    if old:
        folder = f"{place}/folded-{uuid.uuid4().hex}"
        _total(spark, place, state, old).write.parquet(folder)
        versions.point(spark, f"{place}/_folded", {"through": old[-1], "sums": folder}, after=state)


def restated(spark: SparkSession, place: str) -> DataFrame:
    """The metrics of every window as they stand: window_start, n, mae, mse, rmse, r2, tp, fp, fn, tn."""
    place = place.rstrip("/")
    state = versions.current(spark, f"{place}/_folded")
    total = _total(spark, place, state, _batches(spark, place, state.value["through"] if state else -1))
    mse = F.col("square_sum") / F.col("n")
    mean = F.col("label_sum") / F.col("n")
    spread = F.col("label_gap_sum") / F.col("n")
    return total.select(
        "window_start", "n", (F.col("abs_sum") / F.col("n")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"),
        # Means of batches differ by rounding where all labels are equal.
        F.when(spread > 1e-28 * F.greatest(mean * mean, F.lit(1e-300)), 1 - mse / spread).alias("r2"), "tp", "fp", "fn", "tn")
