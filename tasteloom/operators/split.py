"""Train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tasteloom.functions.scalars import hash_bucket
from tasteloom.operators.skew import ROWS_PER_SPLIT, join_by_key
from tasteloom.session import write_once


def user_counts(rows: DataFrame, user: str = "user_id", value: str = "q") -> DataFrame:
    """Interactions per user, counting rows whose value is present."""
    return rows.groupBy(user).agg(F.count(value).alias("n"))


def rows_of_repeat_users(rows: DataFrame, user: str = "user_id", value: str = "q",
                         rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """Rows of users with more than one interaction."""
    counts = rows.groupBy(user).agg(F.count(value).alias("_present"), F.count(F.lit(1)).alias("n"))
    repeat = counts.where("_present > 1").select(user)
    return join_by_key(rows, repeat, user, counts, "left_semi", rows_per_split)


def last_rows(rows: DataFrame, order: Sequence[str], user: str = "user_id",
              value: str = "q") -> DataFrame:
    """The last row of every user with more than one interaction.

    `order` decides what is last, the remaining columns break ties. `max` of the row as a
    struct is combined before the shuffle, so a user's rows are never brought together.
    """
    rest = [c for c in rows.columns if c not in order]
    whole = F.struct(*[F.col(c) for c in [*order, *rest]])
    summary = rows.groupBy(F.col(user).alias("_user")).agg(
        F.max(whole).alias("_last"), F.count(value).alias("_n"))
    return summary.where("_n > 1").select([F.col("_last")[c].alias(c) for c in rows.columns])


def rows_not_in(rows: DataFrame, held_out: DataFrame) -> DataFrame:
    """`rows` without `held_out`, row by row: one held-out row removes one copy."""
    return rows.exceptAll(held_out.select(rows.columns))


def numbered(rows: DataFrame, order: Sequence[str], user: str = "user_id", value: str = "q") -> tuple[DataFrame, DataFrame]:
    """The rows, written with a number `_row`, and (user, n, _last) of every user: its number of rows and the last of
    them as a struct, null for users that keep all their rows."""
    rest = [c for c in rows.columns if c not in order]
    stored = write_once(rows.withColumn("_row", F.monotonically_increasing_id()), "split-rows")
    newest = F.max(F.struct(*[F.col(c) for c in [*order, *rest, "_row"]]))
    users = (stored.where(F.col(user).isNotNull()).groupBy(user)
             .agg(newest.alias("_last"), F.count(value).alias("_n"), F.count(F.lit(1)).alias("n")))
    return stored, users.select(user, "n", F.when(F.col("_n") > 1, F.col("_last")).alias("_last"))


def leave_last_out(rows: DataFrame, order: Sequence[str], user: str = "user_id",
                   value: str = "q") -> DataFrame:
    """Add `split`: each repeat user's last row is `test`, everything else is `train`.

    The rows are written once with a number. A user's last row is the maximum of a struct, combined
    before the shuffle, so a user's rows are never brought together, whatever their number; the
    winners are marked by their numbers. Rows without a user stay in `train`.
    """
    stored, users = numbered(rows, order, user, value)
    test = users.where("_last is not null").select(F.col("_last._row").alias("_row"), F.lit("test").alias("split"))
    return stored.join(test, "_row", "left").select(*rows.columns, F.coalesce("split", F.lit("train")).alias("split"))


def hash_split(df: DataFrame, keys: Sequence[str], train_percent: int = 80) -> DataFrame:
    """Add `split` from a hash of the key columns; the same rows on every run."""
    return df.withColumn("split", F.when(hash_bucket(*keys) < train_percent, "train").otherwise("test"))


def random_split(df: DataFrame, train_share: float = 0.8, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    train, test = df.randomSplit([train_share, 1 - train_share], seed)
    return train, test


def feature_target_split(df: DataFrame, target: str, keys: Sequence[str],
                         train_percent: int = 80) -> DataFrame:
    """Rename the target column to `target` and add `split`."""
    return hash_split(df, keys, train_percent).withColumnRenamed(target, "target")


def part(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name).drop("split")
