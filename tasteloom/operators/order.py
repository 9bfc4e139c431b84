"""Global positions and quantiles without bringing all rows to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tasteloom.session import write_once

LOCAL_POSITION = (1 << 33) - 1  # low bits of monotonically_increasing_id


def _sorted_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`df` range partitioned and sorted, with `_part`; written, because Spark samples the
    range boundaries and could choose others in a second run."""
    return write_once(
        df.repartitionByRange(*columns).sortWithinPartitions(*columns)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_POSITION))),
        "sorted")


def _starts(sizes: DataFrame) -> DataFrame:
    """Sum of `_size` over the partitions before each one. One row per partition, so the
    running sum and a broadcast of it are small by construction."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def number_rows(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Add `out`: the 0-based position of each row in the order of `columns` (distinct rows)."""
    placed = _sorted_once(df, columns)
    starts = _starts(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")))
    return (placed.join(F.broadcast(starts.select("_part", "_start")), "_part")
            .withColumn(out, F.col("_start") + F.col("_pos")).drop("_part", "_pos", "_start"))


def percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """(share, value): exact percentiles with linear interpolation.

    Equal values are counted before anything is sorted, so a value held by most rows is one
    row here. Only the range partitions that hold a wanted rank are looked at row by row.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    placed = _sorted_once(values, ["value"])
    starts = _starts(placed.groupBy("_part").agg(F.sum("n").alias("_size")))
    spans = starts.collect()  # one row per partition
    total = sum(r["_size"] for r in spans)
    if not total:
        return df.sparkSession.createDataFrame([], "share double, value double")
    places = [(s, (total - 1) * s) for s in shares]
    ranks = {int(h) for _, h in places} | {min(int(h) + 1, total - 1) for _, h in places}
    wanted = [r["_part"] for r in spans
              if any(r["_start"] <= k < r["_start"] + r["_size"] for k in ranks)]
    upto = Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    covered = (placed.where(F.col("_part").isin(wanted))
               .join(F.broadcast(starts.select("_part", "_start")), "_part")
               .withColumn("_end", F.col("_start") + F.sum("n").over(upto))
               .withColumn("_begin", F.col("_end") - F.col("n")))
    # Few and known here, so they travel as a constant and each value picks the ranks it covers.
    targets = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(k).cast("long").alias("rank"),
                                 F.lit(float(weight)).alias("weight"))
                        for s, h in places
                        for k, weight in ((int(h), 1 - (h - int(h))), (min(int(h) + 1, total - 1), h - int(h)))])
    hits = F.filter(targets, lambda t: (t["rank"] >= F.col("_begin")) & (t["rank"] < F.col("_end")))
    return (covered.select("value", F.inline(hits))
            .groupBy("share").agg(F.sum(F.col("value") * F.col("weight")).alias("value")))


def hashed_sample(df: DataFrame, key: str, size: int) -> DataFrame:
    """Exactly `size` rows (all when there are fewer), picked by a hash of the unique `key`.

    Only the keys are sorted; they give the last hash that still belongs to the sample.
    """
    hashed = F.md5(F.col(key).cast("string"))
    keys = df.select(hashed.alias("_hash"), key)
    last = number_rows(keys, ["_hash", key], "_at").where(F.col("_at") == size - 1).first()
    if last is None:
        return df if size > 0 else df.limit(0)
    return df.where((hashed < last["_hash"]) | ((hashed == last["_hash"]) & (F.col(key) <= last[key])))
