"""Reading the tables and the settings these operators rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasteloom.session import apply_settings, write_once

# Texts are long rows: small Arrow batches keep a task's memory bounded.
ARROW_ROWS = "2000"
ARROW_BYTES = str(32 << 20)
# Ids that are sent to every task instead of shuffling whole texts to them: some 40 MB. More are joined.
IDS_IN_BROADCAST = 1_000_000


def prepare(spark: SparkSession) -> SparkSession:
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def sized(ids: DataFrame) -> DataFrame:
    """The written table `ids` of one long, to be broadcast if its counted size is below the bound."""
    return F.broadcast(ids) if ids.count() <= IDS_IN_BROADCAST else ids


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the rows whose doc_id is in `gone` (doc_id). The columns are renamed for the join,
    so they can have any names."""
    ids = write_once(gone.select(F.col("doc_id").alias("gone_id")).where("gone_id is not null").distinct(), "gone")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key = F.col(plain.columns[docs.columns.index("doc_id")]).cast("long")
    return plain.join(sized(ids), key == F.col("gone_id"), "left_anti").toDF(*docs.columns)
