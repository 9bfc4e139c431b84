import subprocess
import sys
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from helpers import values
from tasteloom.functions.scalars import rolling_bounds
from tasteloom.session import new_path, shared_dir, write_once
from tasteloom.sources import files
from tasteloom.sources.files import publish
from tasteloom.sources.interactions import load_interactions, load_range


def test_csv_keeps_quotes_and_blanks(spark):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None), (3, "x\\y")], "id int, s string")
    path = new_path(spark, "csv")
    files.write_csv(df, path, single_file=True)
    assert values(files.read_csv(spark, path, df.schema)) == values(df)


def test_ratings_are_read_by_position(spark):
    path = new_path(spark, "ratings")
    files.write_csv(spark.createDataFrame([(7, 1.5, 3)], "a int, b float, c int"), path, header=False)
    assert values(files.read_ratings(spark, path)) == [(7, 1.5, 3)]


def test_publish_writes_the_same_rows_twice(spark):
    df = spark.range(100).select("id", F.rand().alias("r"))  # would differ if computed twice
    for fmt in ("csv", "parquet"):
        run, common = new_path(spark, "run"), new_path(spark, "common")
        files.publish(df, run, common, fmt)
        files.publish(df, new_path(spark, "run"), common, fmt)
        files.publish(df, run, common, fmt)
        read = (lambda p: files.read_csv(spark, p, df.schema)) if fmt == "csv" else (
            lambda p: files.read_parquet(spark, p))
        assert values(read(run)) == values(read(common))


def test_window_bounds_reach_the_scan(spark, small):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    sql = "SELECT * FROM {orders} WHERE o_orderdate BETWEEN {{date_from}} AND {{date_to}}"
    found = load_interactions(spark, sql, date(2000, 1, 31), 30, orders=orders)
    want = orders.where("o_orderdate between timestamp_ntz'2000-01-01' and timestamp_ntz'2000-01-31'")
    assert values(found) == values(want) and found.count() > 0
    assert "GreaterThanOrEqual(o_orderdate" in found._jdf.queryExecution().executedPlan().toString()
    fixed = load_range(spark, sql, date(2000, 1, 1), date(2000, 1, 31), orders=orders)
    assert values(fixed) == values(want)
    assert rolling_bounds(None, 5)[1] - rolling_bounds(None, 5)[0] == timedelta(days=5)


def test_written_tables_are_in_the_shared_folder(spark):
    kept = write_once(spark.range(5).withColumn("r", F.rand()), "t")
    assert kept.inputFiles()[0].split("://")[-1].lstrip("/").startswith(shared_dir(spark).lstrip("/")) or \
        shared_dir(spark) in kept.inputFiles()[0]
    assert values(kept) == values(kept)


def test_publish_keeps_the_latest_readable(spark, tmp_path):
    old, new = spark.range(3), spark.range(5)
    publish(old, str(tmp_path / "run1"), str(tmp_path / "latest"), "parquet")
    publish(new, str(tmp_path / "run2"), str(tmp_path / "latest"), "parquet")
    assert values(spark.read.parquet(str(tmp_path / "latest"))) == values(new)
    broken = spark.range(3).selectExpr("if(id = 2, raise_error('stop'), id) as id")
    with pytest.raises(Exception, match="stop"):
        publish(broken, str(tmp_path / "run3"), str(tmp_path / "latest"), "parquet")
    assert values(spark.read.parquet(str(tmp_path / "latest"))) == values(new)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("latest")) == ["latest"]


def test_intermediate_tables_can_be_dropped(tmp_path):
    """In a session of its own: the folder belongs to the application."""
    code = f'''
from tasteloom.session import build_session, drop_intermediate, write_once
spark = build_session("t", "local[1]", **{{"spark.checkpoint.dir": "{tmp_path}", "spark.ui.enabled": "false"}})
kept = write_once(spark.range(5), "t")
assert kept.count() == 5
drop_intermediate(spark)
import os
print("LEFT", [f for _, _, names in os.walk("{tmp_path}") for f in names])
'''
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert "LEFT []" in done.stdout, done.stderr[-2000:]
