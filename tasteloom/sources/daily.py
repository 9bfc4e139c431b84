"""A rolling window that is kept up to date: interactions stored by day, with sums per day.

Moving the window on adds the sums of the days that come in and takes off those of the days that go out;
the days between are not read. All state is in the folder: `rows` and `sums` by day, the window's own sums
in immutable folders, and the pointer that names the current one.
"""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasteloom.functions.scalars import rolling_bounds
from tasteloom.session import hadoop_path, write_once
from tasteloom.sources import versions

# `kind` is user or item; `n` counts rows, `valued` those with a value. Items are counted within their group.
SUMS = "kind string, grp string, label string, n long, valued long"


def _sums(rows: DataFrame, user: str, item: str, group: str, value: str) -> DataFrame:
    """(day, kind, grp, label, n, valued), added up before the shuffle."""
    def counted(kind: str, grp, label: str):
        return F.struct(F.lit(kind).alias("kind"), grp.cast("string").alias("grp"), F.col(label).cast("string").alias("label"))
    both = F.array(counted("user", F.lit(None), user), counted("item", F.col(group), item))
    return (rows.select("day", F.col(value).isNotNull().cast("long").alias("_valued"), F.inline(both))
            .groupBy("day", "kind", "grp", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("_valued").alias("valued")))


def store_days(rows: DataFrame, place: str, ts: str = "ts", user: str = "user_id", item: str = "item_id",
               group: str = "grp", value: str = "q", keep_rows: bool = True) -> None:
    """Write whole days; a day that is there already is replaced, so a repeated load changes nothing.

    Rows without a time belong to no window and are left out. `rows` has no column `day`. A window that
    covers a replaced day is summed anew when it is next asked for. `keep_rows=False` stores the sums alone.
    """
    if "day" in rows.columns:
        raise ValueError("the column day is the store's own")
    spark, place = rows.sparkSession, place.rstrip("/")
    dated = write_once(rows.where(F.col(ts).isNotNull()).withColumn("day", F.col(ts).cast("date")), "days")

    def save(df: DataFrame, name: str, *order: str) -> None:
        # Ranges of whole days where these are small, parts of a day where one is large: about a file a day.
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        (df.repartitionByRange(tasks, "day", *order).write.mode("overwrite").partitionBy("day")
         .option("partitionOverwriteMode", "dynamic").parquet(f"{place}/{name}"))
    state = versions.current(spark, f"{place}/_window")
    if state and state.value["sums"] and not dated.where(
            F.col("day").between(*_bounds(state))).isEmpty():  # before the days change
        versions.point(spark, f"{place}/_window", {**state.value, "sums": None}, after=state)
    if keep_rows:
        save(dated, "rows", user, item)
    save(_sums(dated, user, item, group, value), "sums", "label")


def _bounds(state: versions.Version) -> tuple[date, date]:
    return date.fromisoformat(state.value["first"]), date.fromisoformat(state.value["last"])


def stored_days(spark: SparkSession, place: str) -> list[date]:
    """The days the store has, ascending: the names of its folders."""
    system, folder = hadoop_path(spark, f"{place.rstrip('/')}/sums")
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    return sorted(date.fromisoformat(name[4:]) for name in names if name.startswith("day="))


def _days(spark: SparkSession, folder: str, schema: str, days: list[date]) -> DataFrame:
    """Those days' folders alone: the store may hold many years, and the others are not even listed."""
    schema = f"{schema}, day date"
    if not days:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", folder).parquet(*[f"{folder}/day={d.isoformat()}" for d in days])


def read_days(spark: SparkSession, place: str, schema: str, first: date, last: date) -> DataFrame:
    """The rows of the days `first` to `last`, both included, with `day`."""
    return _days(spark, f"{place.rstrip('/')}/rows", schema, [d for d in stored_days(spark, place) if first <= d <= last])


def _signed(spark: SparkSession, place: str, days: list[date], sign: int) -> DataFrame:
    sums = _days(spark, f"{place}/sums", SUMS, days)
    return sums.select("kind", "grp", "label", *[(F.col(c) * F.lit(sign)).alias(c) for c in ("n", "valued")])


def change(spark: SparkSession, place: str, state: versions.Version | None, first: date, last: date) -> DataFrame:
    """Sums of the window from `first` to `last`: from the current one and the days by which the two
    differ, or from all its days where there is none that overlaps it."""
    place = place.rstrip("/")
    stored = stored_days(spark, place)
    within = lambda begin, end: [d for d in stored if begin <= d <= end]
    if state is None or not state.value["sums"] or _bounds(state)[1] < first or _bounds(state)[0] > last:
        parts = [_signed(spark, place, within(first, last), 1)]
    else:
        was_first, was_last = _bounds(state)
        one = timedelta(days=1)
        parts = [spark.read.schema(SUMS).parquet(state.value["sums"])]
        for begin, end, sign in ((was_last + one, last, 1), (last + one, was_last, -1),
                                 (first, was_first - one, 1), (was_first, first - one, -1)):
            if days := within(begin, end):
                parts.append(_signed(spark, place, days, sign))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return (total.groupBy("kind", "grp", "label").agg(F.sum("n").alias("n"), F.sum("valued").alias("valued"))
            .where("n > 0"))


def window_sums(spark: SparkSession, place: str, as_of: date | None, days: int) -> DataFrame:
    """(kind, grp, label, n, valued) of the window of `days` that ends on `as_of`, kept for the next call."""
    first, last = rolling_bounds(as_of, days)
    place = place.rstrip("/")
    state = versions.current(spark, f"{place}/_window")
    if not (state and state.value["sums"] and _bounds(state) == (first, last)):
        folder = f"{place}/window-{uuid.uuid4().hex}"
        change(spark, place, state, first, last).write.parquet(folder)
        state = versions.point(spark, f"{place}/_window", {
            "first": first.isoformat(), "last": last.isoformat(), "sums": folder}, after=state)
    return spark.read.schema(SUMS).parquet(state.value["sums"])


def user_counts(sums: DataFrame, user: str = "user_id") -> DataFrame:
    """(user, n): the values of each user in the window, the user as text; users without a name left out."""
    return sums.where("kind = 'user' and label is not null").select(F.col("label").alias(user), F.col("valued").alias("n"))


def popularity(sums: DataFrame, group: str = "grp", item: str = "item_id") -> DataFrame:
    """(group, item, n), as `recommend.popularity` counts them."""
    return sums.where("kind = 'item'").select(F.col("grp").alias(group), F.col("label").alias(item), "n")
