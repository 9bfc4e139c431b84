"""Results behind a version pointer, so that readers never meet a moment without a complete one.

A place is a folder of pointers, small files with ascending numbers that nobody changes once they are
complete. Each holds one JSON object, most often the name of a folder that is complete and stays as it
is. Publishing adds a pointer; readers take the highest complete one. Nothing is renamed or replaced,
which object stores can't do in one step, and going back is publishing an older value again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tasteloom.session import hadoop_path
from tasteloom.sources.files import read_csv, read_parquet, write_csv_once

DIGITS = 12  # numbers sort by name


@dataclass(frozen=True)
class Version:
    number: int
    value: dict


class Conflict(RuntimeError):
    """Another writer has published since the version this one started from."""


def _pointers(spark: SparkSession, place: str) -> list[tuple[int, str]]:
    """(number, path) of all pointers, complete or not, ascending."""
    system, folder = hadoop_path(spark, place)
    if not system.exists(folder):
        return []
    paths = [(s.getPath().getName(), s.getPath().toString()) for s in system.listStatus(folder)]
    return sorted((int(name), path) for name, path in paths if name.isdigit())


def _value(spark: SparkSession, path: str) -> dict | None:
    """A pointer's value; None while its writer has not finished, or if it was lost before it did."""
    system, file = hadoop_path(spark, path)
    stream = system.open(file)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text) if text.endswith("\n") else None


def history(spark: SparkSession, place: str) -> list[Version]:
    """All complete versions, oldest first."""
    found = [Version(number, value) for number, path in _pointers(spark, place)
             if (value := _value(spark, path)) is not None]
    return found


def current(spark: SparkSession, place: str) -> Version | None:
    """The newest complete version; None where nothing was published."""
    for number, path in reversed(_pointers(spark, place)):
        if (value := _value(spark, path)) is not None:
            return Version(number, value)
    return None


def point(spark: SparkSession, place: str, value: dict, after: Version | None | bool = False) -> Version:
    """Publish `value`. With `after` (a version, or None for an empty place) it is a conflict if another
    one was published since; two writers that start from the same version take the same number, which
    the file system gives to one of them."""
    found = current(spark, place)
    if after is not False and (found and found.number) != (after and after.number):
        raise Conflict(f"{place} has moved on to version {found and found.number}")
    used = _pointers(spark, place)
    number = used[-1][0] + 1 if used else 1
    system, file = hadoop_path(spark, f"{place.rstrip('/')}/{number:0{DIGITS}d}")
    try:
        stream = system.create(file, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise Conflict(f"version {number} of {place} was taken by another writer") from error
    stream.write(bytearray(json.dumps(value).encode() + b"\n"))
    stream.close()
    return Version(number, value)


def forget(spark: SparkSession, place: str, keep: int) -> list[Version]:
    """Remove all pointers but the newest `keep` (at least one) and return them. What they name is left;
    its owner deletes it when no reader can still be using it."""
    old = history(spark, place)[:-max(1, keep)]
    for version in old:
        system, file = hadoop_path(spark, f"{place.rstrip('/')}/{version.number:0{DIGITS}d}")
        system.delete(file, False)
    return old


def publish_version(df: DataFrame, run_dir: str, place: str, fmt: str = "csv") -> Version:
    """Write `df` to the run's own folder, which must not exist, and let `place` name it as the latest.

    The rows are written once: the run's folder is the version. Readers that resolved the one before
    keep a folder that nobody touches.
    """
    if fmt == "csv":
        write_csv_once(df, run_dir)
    elif fmt == "parquet":
        df.write.option("compression", "snappy").parquet(run_dir)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return point(df.sparkSession, place, {"folder": run_dir, "format": fmt})


def read_latest(spark: SparkSession, place: str, schema) -> DataFrame:
    """The rows of the latest version. Nothing published is an error."""
    found = current(spark, place)
    if found is None:
        raise FileNotFoundError(f"nothing was published in {place}")
    read = read_csv if found.value["format"] == "csv" else read_parquet
    return read(spark, found.value["folder"], schema)
