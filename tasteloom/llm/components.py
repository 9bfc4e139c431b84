"""Connected components of a link table, by alternating star contractions.

Every node is linked to the smallest of its neighbours and itself; then the links of larger nodes are
moved to that smallest one, until the links are stars around the smallest node of each component. Nodes
with very many links are aggregated before the shuffle and joined, not collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasteloom.session import write_once


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in `links` (a, b): the smallest node reachable from it."""
    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    stars = write_once(_small_star(links), "stars")
    before = state(stars)
    while before[0]:
        stars = write_once(_small_star(_large_star(stars)), "stars")
        after = state(stars)
        if after == before:
            break
        before = after
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
