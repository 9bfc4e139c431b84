from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import values
from tasteloom.operators import recommend, split
from tasteloom.session import new_path
from tasteloom.sources import daily, versions

ROWS = "user_id long, item_id string, grp string, q double, ts timestamp_ntz"


def made(spark, days):
    rows = [(n % 3 or None, f"i{n % 5}" if n % 7 else None, f"g{n % 2}", None if n % 4 == 0 else 1.0,
             datetime(2020, 1, d, n % 24)) for d in days for n in range(d % 6 + 2)]
    return spark.createDataFrame([*rows, (1, "i0", "g0", 1.0, None)], ROWS)


def check(spark, place, rows, last, days):
    """The kept sums equal the full query over the window."""
    sums = daily.window_sums(spark, place, last, days)
    inside = rows.where(F.col("ts").cast("date").between(last - timedelta(days), last))
    assert values(daily.popularity(sums)) == values(recommend.popularity(inside))
    users = split.user_counts(inside.where("user_id is not null")).select(F.col("user_id").cast("string"), "n")
    assert values(daily.user_counts(sums)) == values(users)


def test_moved_windows_equal_full_ones(spark):
    rows, place = made(spark, range(1, 13)), new_path(spark, "days")
    daily.store_days(rows, place)
    for day in (6, 7, 7, 9, 8, 12):  # on by a day, again, by two, back, and on
        check(spark, place, rows, date(2020, 1, day), 3)
    check(spark, place, rows, date(2020, 1, 12), 6)  # a longer window
    check(spark, place, rows, date(2020, 1, 3), 1)  # one that does not overlap
    check(spark, place, rows, date(2021, 1, 3), 1)  # no rows


def test_a_step_reads_two_days(spark):
    place = new_path(spark, "days")
    daily.store_days(made(spark, range(1, 13)), place)
    daily.window_sums(spark, place, date(2020, 1, 8), 5)
    state = versions.current(spark, f"{place}/_window")
    step = daily.change(spark, place, state, date(2020, 1, 4), date(2020, 1, 9))
    read = {f.split("day=")[1][:10] for f in step.inputFiles() if "day=" in f}
    assert read == {"2020-01-09", "2020-01-03"}
    assert daily.stored_days(spark, place) == [date(2020, 1, d) for d in range(1, 13)]


def test_a_day_loaded_again_replaces_itself(spark):
    place, rows = new_path(spark, "days"), made(spark, range(1, 8))
    daily.store_days(rows, place)
    check(spark, place, rows, date(2020, 1, 6), 3)
    daily.store_days(rows.where("ts is null or to_date(ts) = date'2020-01-05'"), place)
    check(spark, place, rows, date(2020, 1, 6), 3)
    late = rows.where("to_date(ts) = date'2020-01-05'").unionByName(
        spark.createDataFrame([(9, "new", "g0", 2.0, datetime(2020, 1, 5, 3))], ROWS))
    daily.store_days(late, place)
    rows = rows.where("ts is null or to_date(ts) <> date'2020-01-05'").unionByName(late)
    check(spark, place, rows, date(2020, 1, 6), 3)
    check(spark, place, rows, date(2020, 1, 7), 3)
    stored = daily.read_days(spark, place, ROWS, date(2020, 1, 5), date(2020, 1, 5)).drop("day")
    assert values(stored) == values(late)


def test_empty_store_and_clashing_column(spark):
    place = new_path(spark, "days")
    daily.store_days(made(spark, [3]), place)
    daily.store_days(made(spark, []), place)  # only a row without a time
    check(spark, place, made(spark, [3]), date(2020, 1, 3), 2)
    with pytest.raises(ValueError, match="day"):
        daily.store_days(made(spark, [3]).withColumn("day", F.lit(1)), place)
