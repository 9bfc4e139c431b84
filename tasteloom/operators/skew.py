"""Joins on a key that may be shared by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A key with more rows than this is split. There are at most rows / ROWS_PER_SPLIT such keys, so their
# table (12 bytes a key) is a millionth of the data and can be broadcast.
ROWS_PER_SPLIT = 1_000_000
NULL_SPLITS = (1 << 31) - 1


def split_count(rows: Column, rows_per_split: int = ROWS_PER_SPLIT) -> Column:
    return F.ceil(rows / F.lit(rows_per_split)).cast("int")


def row_salt(columns: list[str], splits: Column) -> Column:
    """A split number for this row.

    The partition number spreads identical rows too. It is a property of where a row already
    is, so a task that is run again gives its rows the same salt.
    """
    return F.pmod(F.xxhash64(*columns) + F.spark_partition_id(), splits).cast("int")


def hot_keys(counts: DataFrame, key: str, rows: str = "n",
             rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """(key, splits) for the keys with more than `rows_per_split` rows."""
    return (counts.where(F.col(key).isNotNull() & (F.col(rows) > rows_per_split))
            .select(key, split_count(F.col(rows), rows_per_split).alias("_splits")))


def join_by_key(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame,
                how: str = "inner", rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Join `rows` with `table` on `key`, splitting the keys `counts` (key, n) shows as hot.

    Rows of a hot key are spread over `_splits` tasks and the matching `table` rows are
    repeated once per split. Spark still chooses the join: it broadcasts `table` when its
    measured size is small and shuffles both sides otherwise.
    """
    hot = F.broadcast(hot_keys(counts, key, rows_per_split=rows_per_split))
    one = F.coalesce(F.col("_splits"), F.lit(1))
    # Null keys match nothing, so an outer join may spread them as widely as it likes.
    spread = F.when(F.col(key).isNull(), F.lit(NULL_SPLITS)).otherwise(one)
    left = (rows.join(hot, key, "left")
            .withColumn("_salt", row_salt(rows.columns, spread)).drop("_splits"))
    right = (table.join(hot, key, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_splits"))
    return left.join(right, [key, "_salt"], how).drop("_salt")
