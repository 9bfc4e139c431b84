"""The canonical frames of the package, read from the tables of a data folder."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasteloom.operators.clean import clean_interactions, exclude
from tasteloom.operators.split import hash_split
from tasteloom.sources.interactions import load_interactions

# Fixed values of the catalogue: what stands in for the two currencies and the three groups.
EXCLUDED = ("Brand#1", "Brand#2")
QUOTAS = {"ECONOMY": 3, "SMALL": 3, "PROMO": 4}
AS_OF = date(2001, 8, 1)
DAYS = 365
# What makes a user's row the last one; the full list leaves no ties between different rows.
ORDER = ("ts", "order_id", "line_no", "item_id", "q")

INTERACTIONS = """
SELECT o_custkey AS user_id, CAST(l_partkey AS STRING) AS item_id, p_type AS grp, p_brand AS ticker,
       l_quantity AS q, o_orderdate AS ts, l_orderkey AS order_id, l_linenumber AS line_no
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
"""
WINDOW = "WHERE o_orderdate BETWEEN {{date_from}} AND {{date_to}}"


# Declared, so opening a table starts no job.
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: table(spark, folder, n) for n in ("lineitem", "orders", "part")}


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(INTERACTIONS, **_sources(spark, folder))


def recent_interactions(spark: SparkSession, folder: str, as_of: date = AS_OF, days: int = DAYS) -> DataFrame:
    return load_interactions(spark, INTERACTIONS + WINDOW, as_of, days, **_sources(spark, folder))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return clean_interactions(interactions(spark, folder), EXCLUDED)


def watchlist(spark: SparkSession, folder: str) -> DataFrame:
    """Views of items: the watch-list form of the interactions."""
    return (table(spark, folder, "events").where("event_type = 'view'")
            .select("user_id", F.get_json_object("props", "$.k").alias("item_id"), F.col("value").alias("q"),
                    "ts", "event_id"))


def ratings(spark: SparkSession, folder: str, split: bool = False) -> DataFrame:
    """(user, item, q, order_id, line_no) with plain integer items: ALS input. With `split` also the part by a hash
    of order, line and item, taken from the lines, so that keys nobody asks for later do not travel."""
    lines, orders = table(spark, folder, "lineitem"), table(spark, folder, "orders")
    if split:
        item = F.col("l_partkey").cast("int")
        lines = hash_split(lines.withColumn("_item", item), ["l_orderkey", "l_linenumber", "_item"]).drop("_item")
    kept = exclude(table(spark, folder, "part"), "p_brand", EXCLUDED).select("p_partkey")
    return (lines.join(orders, lines.l_orderkey == orders.o_orderkey)
            .join(kept, lines.l_partkey == kept.p_partkey)
            .select(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item"),
                    F.col("l_quantity").cast("float").alias("q"), F.col("l_orderkey").alias("order_id"),
                    F.col("l_linenumber").alias("line_no"), *(["split"] if split else [])))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def factor_table(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors read as factors of a fixed model: (idx, w, v)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("idx"), F.col("label").cast("double").alias("w"), F.col("embedding").alias("v"))
