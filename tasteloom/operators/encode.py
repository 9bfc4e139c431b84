"""Dense codes for labels and the sparse rows built from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tasteloom.operators.order import number_rows
from tasteloom.operators.skew import ROWS_PER_SPLIT, join_by_key
from tasteloom.operators.split import numbered
from tasteloom.session import new_path, write_once


def dense_index(df: DataFrame, label: str) -> DataFrame:
    """(label, idx, n): labels as text in text order, numbered from 0, with their row count."""
    labels = (df.select(F.col(label).cast("string").alias("label")).where("label is not null")
              .groupBy("label").agg(F.count(F.lit(1)).alias("n")))
    return number_rows(labels, ["label"], "idx").select("label", "idx", "n")


@dataclass
class PairIndex:
    """Codes of both fields. `stacked` is (idx, kind, label, n), users first and items after."""
    stacked: DataFrame
    nb_users: int
    nb_items: int
    most_rows: dict[str, int]  # rows of the most frequent label, by kind

    @property
    def users(self) -> DataFrame:
        return self.stacked.where("kind = 'user'").select("label", "idx", "n")

    @property
    def items(self) -> DataFrame:
        return self.stacked.where("kind = 'item'").select(
            "label", (F.col("idx") - F.lit(self.nb_users)).alias("idx"), "n")


def pair_index(rows: DataFrame, user: str = "user_id", item: str = "item_id") -> PairIndex:
    """Index users and items in one pass: the fields are sorted one after the other."""
    def named(kind: str, place: int, column: str):
        return F.struct(F.lit(place).alias("_field"), F.lit(kind).alias("kind"),
                        F.col(column).cast("string").alias("label"))
    labels = (rows.select(F.inline(F.array(named("user", 0, user), named("item", 1, item))))
              .where("label is not null").groupBy("_field", "kind", "label").agg(F.count(F.lit(1)).alias("n")))
    return _stacked(labels)


def _stacked(labels: DataFrame) -> PairIndex:
    """The index of counted labels (_field, kind, label, n)."""
    stacked = number_rows(labels, ["_field", "label"], "idx").select("idx", "kind", "label", "n")
    sizes = {r["kind"]: r for r in stacked.groupBy("kind").agg(
        F.count(F.lit(1)).alias("labels"), F.max("n").alias("most")).collect()}  # two rows
    count = lambda kind, column: sizes[kind][column] if kind in sizes else 0
    return PairIndex(stacked, count("user", "labels"), count("item", "labels"),
                     {kind: count(kind, "most") for kind in ("user", "item")})


def ordinal_encode(rows: DataFrame, label: str, index: DataFrame, out: str,
                   how: str = "inner", rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Add the code of `label` as `out`; `how='left'` gives null to labels not in the index."""
    is_text = isinstance(rows.schema[label].dataType, StringType)  # then it need not travel twice
    key = label if is_text else "_label"
    keyed = rows if is_text else rows.withColumn(key, F.col(label).cast("string"))
    codes = index.select(F.col("label").alias(key), F.col("idx").alias(out))
    counts = index.select(F.col("label").alias(key), "n")
    return join_by_key(keyed, codes, key, counts, how, rows_per_split).select(*rows.columns, out)


def stack_index(users: DataFrame, items: DataFrame) -> DataFrame:
    """One index map: users first, items after them. `users` and `items` come from dense_index."""
    nb_users = users.count()
    return (users.select("idx", F.lit("user").alias("kind"), "label")
            .unionByName(items.select((F.col("idx") + nb_users).alias("idx"),
                                      F.lit("item").alias("kind"), "label")))


def cardinalities(rows: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """nb_users, nb_items and their sum, the width of the one-hot row."""
    counts = rows.agg(F.count_distinct(user).alias("nb_users"), F.count_distinct(item).alias("nb_items"))
    return counts.withColumn("feature_dim", F.col("nb_users") + F.col("nb_items"))


def encode_pairs(rows: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id",
                 item: str = "item_id") -> DataFrame:
    """Add `user_idx` and `item_idx` from indexes fitted on train rows; unseen labels are null."""
    with_user = ordinal_encode(rows, user, users, "user_idx", "left")
    return ordinal_encode(with_user, item, items, "item_idx", "left")


def split_and_encode(rows: DataFrame, order: Sequence[str], user: str = "user_id", item: str = "item_id", value: str = "q",
                     rows_per_split: int = ROWS_PER_SPLIT) -> tuple[DataFrame, PairIndex]:
    """`leave_last_out`, the index of its train rows, and `encode_pairs`, with fewer passes over the rows.

    A user's last row is known from the user alone. So its mark travels with the user's code, and the labels
    of the train rows are those of all rows less the held-out ones.
    """
    stored, users = numbered(rows, order, user, value)
    held = F.col("_last").isNotNull()
    users = write_once(users.select(user, "n", F.col("_last._row").alias("_last_row"), F.when(held, 1).otherwise(0).alias("_held"),
                                    F.col(f"_last.{item}").cast("string").alias("_item")), "last-rows")
    of_users = users.select(F.lit(0).alias("_field"), F.lit("user").alias("kind"), F.col(user).cast("string").alias("label"),
                            (F.col("n") - F.col("_held")).alias("n")).where("n > 0")
    seen = stored.select(F.col(item).cast("string").alias("label"), F.lit(1).alias("n"))
    gone = users.where("_held = 1").select(F.col("_item").alias("label"), F.lit(-1).alias("n"))
    of_items = (seen.unionByName(gone).where("label is not null").groupBy("label").agg(F.sum("n").alias("n")).where("n > 0")
                .select(F.lit(1).alias("_field"), F.lit("item").alias("kind"), "label", "n"))
    index = _stacked(of_users.unionByName(of_items))
    codes = index.users.select(F.col("label").alias("_label"), F.col("idx").alias("user_idx"))
    known = users.withColumn("_label", F.col(user).cast("string")).join(codes, "_label", "left")
    known = write_once(known.select(user, "user_idx", "_last_row", "n"), "user-codes")
    marked = join_by_key(stored, known.drop("n"), user, known.select(user, "n"), "left", rows_per_split).select(
        *rows.columns, F.when(F.col("_row") == F.col("_last_row"), "test").otherwise("train").alias("split"), "user_idx")
    return ordinal_encode(marked, item, index.items, "item_idx", "left", rows_per_split), index


def one_hot_pairs(encoded: DataFrame, nb_users: int, keys: list[str]) -> DataFrame:
    """One row per non-zero of the design matrix: the key columns and `idx`."""
    columns = F.array(F.col("user_idx"), F.col("item_idx") + F.lit(nb_users))
    return (encoded.select(*keys, F.explode(columns).alias("idx")).where("idx is not null"))


def one_hot_vectors(train: DataFrame, encoded: DataFrame, label: str = "q", sizes: tuple[int, int] | None = None) -> DataFrame:
    """`features` (sparse, one slot per train user and item) and `label` for `encoded` rows.

    `sizes` are the numbers of train users and items; without them `train` is read for its largest codes. The
    cells are written as they are stored and read as vectors: Spark's encoder would name each slot in the
    column's metadata, on the driver and in every file.
    """
    spark = encoded.sparkSession
    nb_users, nb_items = sizes or [(most + 1 if most is not None else 0) for most in train.agg(
        F.max("user_idx"), F.max("item_idx")).first()]
    places = F.array_compact(F.array(F.col("user_idx"), F.col("item_idx") + F.lit(nb_users))).cast("array<int>")
    cells = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(nb_users + nb_items).cast("int").alias("size"),
                     places.alias("indices"), F.array_repeat(F.lit(1.0), F.size(places)).alias("values"))
    matrix = encoded.withColumn("features", cells).withColumn("label", F.col(label).cast("double"))
    path = new_path(spark, "vectors")
    matrix.write.parquet(path)
    kept = [f for f in matrix.schema if f.name != "features"]
    return spark.read.schema(StructType([*kept, StructField("features", VectorUDT())])).parquet(path).select(
        *[c for c in matrix.columns if c not in ("features", "label")], "features", "label")
