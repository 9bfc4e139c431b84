"""Session settings and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this package relies on. They are plain Spark options, so a cluster
# profile can set them as well; `build_session` applies them to sessions it creates.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join side even where that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Ten thousand texts are a batch otherwise, whose buffers the JVM and the Python worker of every core hold and keep.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    # A table that was bucketed by a key is read and joined in its buckets, and the other side follows.
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Streaming state on local disk rather than on the heap; checkpoints go to shared storage.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "tasteloom", master: str | None = None, **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **options}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the same options on a session that was created elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    It has to outlive executors, so on a cluster it must be configured; only a local master
    falls back to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tasteloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{run_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def replace_folder(spark: SparkSession, new: str, path: str) -> None:
    """Put the complete folder `new` in the place of `path`. Two renames: a reader finds the old
    folder, for a moment none, then the new one, but never a part of either."""
    system, fresh = hadoop_path(spark, new)
    _, target = hadoop_path(spark, path)
    _, old = hadoop_path(spark, f"{path.rstrip('/')}-old-{uuid.uuid4().hex}")
    if system.exists(target) and not system.rename(target, old):
        raise OSError(f"cannot move {path} aside")
    if not system.rename(fresh, target):
        raise OSError(f"cannot rename {new} to {path}")
    system.delete(old, True)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Call it when its results are saved."""
    system, path = hadoop_path(spark, run_dir(spark))
    system.delete(path, True)


def write_once(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and return a scan of it.

    Cuts the lineage and pins what was computed: a lost executor re-reads files instead of
    recomputing, and every later reader sees the same rows in the same partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
