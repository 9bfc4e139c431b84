"""Dense codes that stay: an index that new labels are added behind, so that factors, matrices and
published lists of earlier runs keep their meaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasteloom.operators.encode import PairIndex
from tasteloom.operators.order import number_rows
from tasteloom.session import write_once
from tasteloom.sources import versions

LABELS = "label string, idx long"
MERGE_PARTS = 32  # an index in as many parts is written anew as one


def _read(spark: SparkSession, place: str, parts: list[str]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], LABELS)
    return spark.read.schema(LABELS).parquet(*[f"{place}/{part}" for part in parts])


def read_dictionary(spark: SparkSession, place: str, number: int | None = None) -> DataFrame:
    """(label, idx) of the newest version, or of an earlier one by its number."""
    place = place.rstrip("/")
    found = (versions.current(spark, f"{place}/_versions") if number is None else
             next((v for v in versions.history(spark, f"{place}/_versions") if v.number == number), None))
    if found is None:
        raise FileNotFoundError(f"no such version of an index in {place}")
    return _read(spark, place, found.value["parts"])


def extend(rows: DataFrame, label: str, place: str) -> DataFrame:
    """(label, idx, n): the index at `place` with the labels of `rows` that it lacks added behind, and the
    number of their rows here (0 for labels that `rows` does not have).

    Known labels keep their code. New ones follow in text order, so the first version is `dense_index`.
    Null labels have no code. Only distinct labels are joined, and only new ones are sorted and written;
    a version without new labels writes nothing. Of two writers from one version the second is refused
    (`versions.Conflict`) and can run again.
    """
    spark, place = rows.sparkSession, place.rstrip("/")
    counts = write_once(rows.select(F.col(label).cast("string").alias("label")).where("label is not null")
                        .groupBy("label").agg(F.count(F.lit(1)).alias("n")), "labels")
    begin = versions.current(spark, f"{place}/_versions")
    parts, size = (begin.value["parts"], begin.value["size"]) if begin else ([], 0)
    known = _read(spark, place, parts)
    fresh = number_rows(counts.join(known, "label", "left_anti").select("label"), ["label"], "_at").select(
        "label", (F.col("_at") + F.lit(size)).alias("idx"))
    part = f"part-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{place}/{part}")
    added = _read(spark, place, [part]).count()
    if added or begin is None:
        parts = [*parts, part]
        if len(parts) >= MERGE_PARTS:
            merged = f"part-{uuid.uuid4().hex}"
            _read(spark, place, parts).write.parquet(f"{place}/{merged}")
            parts = [merged]  # the old parts stay for readers of earlier versions
        versions.point(spark, f"{place}/_versions", {"parts": parts, "size": size + added}, after=begin)
    return _read(spark, place, parts).join(counts, "label", "left").select(
        "label", "idx", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def extend_pair(rows: DataFrame, place: str, user: str = "user_id", item: str = "item_id") -> PairIndex:
    """The codes of both fields, kept in `place`. Codes within a field stay; stacked positions of items
    move on when users are added, as users stand before them."""
    users = write_once(extend(rows, user, f"{place.rstrip('/')}/user"), "users")
    items = write_once(extend(rows, item, f"{place.rstrip('/')}/item"), "items")
    named = users.select(F.lit("user").alias("kind"), "label", "idx", "n").unionByName(
        items.select(F.lit("item").alias("kind"), "label", "idx", "n"))
    sizes = {r["kind"]: r for r in named.groupBy("kind").agg(
        F.count(F.lit(1)).alias("labels"), F.max("n").alias("most")).collect()}  # two rows
    count = lambda kind, column: sizes[kind][column] if kind in sizes else 0
    before = F.when(F.col("kind") == "item", F.lit(count("user", "labels"))).otherwise(F.lit(0))
    stacked = named.select((F.col("idx") + before).alias("idx"), "kind", "label", "n")
    return PairIndex(stacked, count("user", "labels"), count("item", "labels"),
                     {kind: count(kind, "most") for kind in ("user", "item")})
