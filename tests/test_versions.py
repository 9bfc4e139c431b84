import threading

import pytest

from helpers import values
from tasteloom.session import hadoop_path, new_path
from tasteloom.sources import versions


def test_readers_get_the_newest_complete_version(spark):
    place = new_path(spark, "place")
    assert versions.current(spark, place) is None and versions.history(spark, place) == []
    with pytest.raises(FileNotFoundError):
        versions.read_latest(spark, place, "id long")
    for fmt in ("csv", "parquet"):
        for n in (3, 0):  # an empty result is a result
            df = spark.range(n)
            versions.publish_version(df, new_path(spark, "run"), place, fmt)
            assert values(versions.read_latest(spark, place, df.schema)) == values(df)
    assert [v.number for v in versions.history(spark, place)] == [1, 2, 3, 4]
    system, file = hadoop_path(spark, f"{place}/{5:012d}")  # a writer that was lost before it wrote
    system.create(file, False).close()
    assert versions.current(spark, place).number == 4
    assert versions.point(spark, place, {"folder": "x"}).number == 6


def test_a_run_is_not_overwritten(spark):
    place, run = new_path(spark, "place"), new_path(spark, "run")
    versions.publish_version(spark.range(3), run, place)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        versions.publish_version(spark.range(4), run, place)
    assert versions.read_latest(spark, place, "id long").count() == 3
    with pytest.raises(ValueError, match="unknown format"):
        versions.publish_version(spark.range(3), new_path(spark, "run"), place, "xml")


def test_going_back_and_forgetting(spark):
    place = new_path(spark, "place")
    for n in (1, 2, 3):
        versions.publish_version(spark.range(n), new_path(spark, "run"), place)
    versions.point(spark, place, versions.history(spark, place)[0].value)
    assert versions.read_latest(spark, place, "id long").count() == 1
    assert [v.number for v in versions.forget(spark, place, 2)] == [1, 2]
    assert [v.number for v in versions.history(spark, place)] == [3, 4]
    versions.forget(spark, place, 0)
    assert versions.current(spark, place).number == 4


def test_the_second_of_two_writers_from_one_version_is_refused(spark):
    place = new_path(spark, "place")
    start = versions.point(spark, place, {"n": 0}, after=None)
    versions.point(spark, place, {"n": 1}, after=start)
    with pytest.raises(versions.Conflict):
        versions.point(spark, place, {"n": 2}, after=start)
    with pytest.raises(versions.Conflict):
        versions.point(spark, place, {"n": 2}, after=None)
    assert versions.current(spark, place).value == {"n": 1}


def test_a_polling_reader_never_fails(spark):
    place, done, seen, errors = new_path(spark, "place"), threading.Event(), set(), []
    versions.publish_version(spark.range(1), new_path(spark, "run"), place, "parquet")

    def poll():
        while not done.is_set():
            try:
                seen.add(versions.read_latest(spark, place, "id long").count())
            except Exception as error:
                errors.append(error)

    reader = threading.Thread(target=poll)
    reader.start()
    for n in range(2, 8):
        versions.publish_version(spark.range(n), new_path(spark, "run"), place, "parquet")
    done.set()
    reader.join()
    assert not errors and seen <= set(range(1, 8))
