"""From scored lists to published recommendation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

# How many items of each group make up the general recommendation.
GROUP_QUOTAS = {"CEDEARS": 3, "Acciones": 3, "Renta Fija": 4}


def item_dimension(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*columns).distinct()


def popularity(recs: DataFrame, group: str = "grp", item: str = "item_id") -> DataFrame:
    """How often each item occurs in each group."""
    return recs.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))


def general_recommendation(recs: DataFrame, quotas: dict[str, int] = GROUP_QUOTAS, group: str = "grp",
                           item: str = "item_id") -> DataFrame:
    """The most frequent items of each group, up to the group's quota, most frequent first.

    The constant bound on the rank lets Spark cut each group before the shuffle, so a group's
    whole catalogue never meets in one task.
    """
    return quota_heads(popularity(recs.where(F.col(group).isin(list(quotas))), group, item), quotas, group, item)


def quota_heads(counted: DataFrame, quotas: dict[str, int] = GROUP_QUOTAS, group: str = "grp",
                item: str = "item_id") -> DataFrame:
    """The same from (group, item, n) that are counted already."""
    counted = counted.where(F.col(group).isin(list(quotas)))
    ranked = counted.withColumn("rn", F.row_number().over(
        Window.partitionBy(group).orderBy(F.col("n").desc(), item)))
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col(group)]
    return (ranked.where((F.col("rn") <= max(quotas.values())) & (F.col("rn") <= quota)).drop("rn")
            .orderBy(F.col("n").desc(), group, item))


def general_recommendation_union(recs: DataFrame, quotas: dict[str, int] = GROUP_QUOTAS, group: str = "grp",
                                 item: str = "item_id") -> DataFrame:
    """The same as a union of one head per group."""
    counted = popularity(recs, group, item)
    heads = [counted.where(F.col(group) == name).orderBy(F.col("n").desc(), item).limit(quota)
             for name, quota in quotas.items()]
    return reduce(DataFrame.unionByName, heads).orderBy(F.col("n").desc(), group, item)


def explode_recommendations(lists: DataFrame, user: str, column: str = "recommendations") -> DataFrame:
    """One row per list entry, its struct fields as columns, and `rank` from 1."""
    return (lists.select(user, F.posexplode(column).alias("_pos", "_rec"))
            .select(user, "_rec.*", (F.col("_pos") + 1).alias("rank")))


def neighbour_lists(neighbours: DataFrame, row: str = "query_id") -> DataFrame:
    """(row, distances, labels): the neighbours of each row as two lists, nearest first."""
    pairs = F.sort_array(F.collect_list(F.struct("distance", "item_id")))
    return (neighbours.groupBy(F.col(row).alias("row")).agg(pairs.alias("_pairs"))
            .select("row", F.col("_pairs.distance").alias("distances"),
                    F.col("_pairs.item_id").alias("labels")))


def flatten_neighbours(lists: DataFrame) -> DataFrame:
    """(row, rank, label, distance) from the two lists. Every row keeps its own key and length."""
    zipped = F.posexplode(F.arrays_zip("distances", "labels")).alias("_pos", "_pair")
    return (lists.select("row", F.size("distances").alias("k"), zipped)
            .select("row", "k", (F.col("_pos") + 1).alias("rank"),
                    F.col("_pair.labels").alias("label"), F.col("_pair.distances").alias("distance")))


def attach_dimension(recs: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join on the item. An item with several dimension rows multiplies its rows.

    No broadcast is forced: Spark picks one when the dimension's measured size is small, and
    otherwise splits the skewed items of the shuffled join. It can do so when the dimension is a
    table; one that is still being aggregated should be written first (`session.write_once`).
    """
    return recs.join(dimension, key, "left")


def decode_index(flat: DataFrame, index: DataFrame, nb_users: int) -> DataFrame:
    """Replace positions by labels; `flat` is (row, label, ...) with item positions from 0."""
    users = index.where("kind = 'user'").select(F.col("idx").alias("row"), F.col("label").alias("user_id"))
    items = index.where("kind = 'item'").select((F.col("idx") - nb_users).alias("label"),
                                                F.col("label").alias("item_id"))
    return flat.join(users, "row").join(items, "label", "left").drop("row", "label")


def exclude_seen(recs: DataFrame, seen: DataFrame, user: str, item: str) -> DataFrame:
    """Optional filter: drop recommendations of items the user already has."""
    return recs.join(seen.select(user, item).distinct(), [user, item], "left_anti")
