import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from helpers import values
from tasteloom.functions import scalars
from tasteloom.operators import evaluate, monitor
from tasteloom.plans import catalog
from tasteloom.session import new_path
from tasteloom.streaming import monitors as streams

SCHEMA = "event_id long, ts timestamp_ntz, kind string, value double"


def at(hour, minute=0, day=1):
    return datetime(2024, 1, day, hour, minute)


@pytest.fixture
def baseline(spark):
    return spark.createDataFrame([(1, at(0), "a", 1.0), (2, at(0, 5), "b", 3.0), (3, at(1), "a", None)], SCHEMA)


def test_profile(baseline):
    found = {r["column"]: r for r in monitor.profile(baseline, ["value", "kind"]).collect()}
    v = found["value"]
    assert (v["n_rows"], v["n_distinct"], v["min"], v["max"], v["mean"], v["stddev"], v["sum"]) == (3, 2, 1, 3, 2, 1, 4)
    assert abs(v["completeness"] - 2 / 3) < 1e-12 and found["kind"]["min"] is None
    assert monitor.profile(baseline, ["kind"], approx_distinct=True).first()["n_distinct"] == 2


def test_constraints_and_breaches(spark, baseline):
    rules = monitor.suggest_constraints(baseline, ["value", "kind"], max_allowed=3)
    assert values(rules, "column", "kind") == [
        ("kind", "allowed_values"), ("kind", "completeness"), ("kind", "type"), ("value", "completeness"),
        ("value", "non_negative"), ("value", "range"), ("value", "type")]
    events = spark.createDataFrame([
        (1, at(5), "a", 2.0), (2, at(6), "new", -1.0), (3, at(6, 1), None, 9.0), (4, at(7), "a", None)], SCHEMA)
    found = monitor.data_quality(events, rules, "ts")
    assert values(found, "window_start", "column", "kind", "observed") == [
        (at(6), "kind", "allowed_values", 1.0), (at(6), "kind", "completeness", 0.5),
        (at(6), "value", "non_negative", -1.0), (at(6), "value", "range_high", 9.0),
        (at(6), "value", "range_low", -1.0), (at(7), "value", "completeness", 0.0)]
    hooked = monitor.data_quality(events, rules, "ts", preprocess=lambda d: d.where("kind = 'new'"),
                                  postprocess=lambda d: d.where("kind = 'non_negative'"))
    assert hooked.count() == 1


def test_many_values_give_a_note_instead_of_a_list(spark):
    df = spark.range(50).selectExpr("cast(id as string) s", "timestamp_ntz '2024-01-01' as ts")
    rules = monitor.suggest_constraints(df, ["s"], max_allowed=10)
    assert values(rules, "kind", "lo") == [("completeness", 1.0), ("type", 1.0), ("values_not_listed", 50.0)]
    assert monitor.data_quality(df, rules, "ts").count() == 0
    listed = monitor.suggest_constraints(df, ["s"], max_allowed=50)
    assert "allowed_values" in [r["kind"] for r in listed.collect()]


def test_baselines_without_values(spark, baseline):
    nothing = spark.createDataFrame([(1, at(0), None, None)], SCHEMA)
    rules = monitor.suggest_constraints(nothing, ["value", "kind"])
    assert values(rules, "column", "kind", "lo") == [("kind", "completeness", 0.0), ("value", "completeness", 0.0)]
    none = monitor.suggest_constraints(nothing.limit(0), ["value", "kind"])
    assert none.count() == 0
    found = monitor.data_quality(baseline, none, "ts")
    assert found.columns == ["window_start", "column", "kind", "observed", "bound"] and found.count() == 0


def test_metric_bounds_and_breaches(spark):
    rows = [(at(h), float(p), float(y)) for h, p, y in [(0, 1, 2), (0, 4, 2), (1, 5, 5), (1, 6, 5), (2, 9, 1), (3, 1, 1)]]
    joined = spark.createDataFrame(rows, "ts timestamp_ntz, prediction double, label double")
    metrics = evaluate.regression_metrics()
    bounds = monitor.suggest_metric_bounds(joined.where("hour(ts) < 2"), metrics, ["mae"], ["r2"])
    assert values(bounds, "metric", "bound", "is_floor")[0] == ("mae", 1.0, False)
    found = monitor.metric_breaches(monitor.model_quality(joined, "ts", metrics), bounds)
    assert (at(2), "mae", 8.0, 1.0) in values(found) and (at(0), "mae", 1.5, 1.0) in values(found)
    assert not [r for r in found.collect() if r["window_start"] == at(3) and r["metric"] == "mae"]
    assert monitor.metric_breaches(monitor.model_quality(joined, "ts", metrics), bounds.limit(0)).count() == 0


def test_capture_sample(spark):
    df = spark.range(4000).selectExpr("id", "'in' as request", "'out' as response")
    payloads = {"REQUEST": "request", "RESPONSE": "response"}
    found = monitor.capture_sample(df, "id", payloads)
    assert 0.17 < found.count() / 8000 < 0.23
    assert values(found.groupBy("kind", "payload").count(), "kind", "payload") == [("REQUEST", "in"), ("RESPONSE", "out")]
    assert monitor.capture_sample(df, "id", payloads, 100, ["REQUEST"]).count() == 4000


def test_latest(spark):
    df = spark.createDataFrame([(1, at(1)), (2, at(2)), (3, at(2))], "id long, ts timestamp_ntz")
    assert [r["id"] for r in monitor.latest(df, "ts", "id", 2).collect()] == [3, 2]


def write_batches(spark, *batches):
    folder = new_path(spark, "incoming")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_events_behind_the_watermark_are_dropped(spark):
    folder = write_batches(spark, [(1, at(1), "a", 5.0), (2, at(9), "a", 7.0)])
    late = write_batches(spark, [(3, at(1, 30), "a", 100.0), (4, at(12), "error", 1.0)])
    schema = spark.read.parquet(folder).schema
    path, state = new_path(spark, "ops"), new_path(spark, "ops-state")
    incoming = new_path(spark, "both")

    def run(source):
        spark.read.parquet(source).coalesce(1).write.mode("append").parquet(incoming)
        stream = streams.operations(streams.read_events(spark, incoming, schema), F.col("kind") == "error", "value")
        query = streams.start(stream, path, state)
        assert query.awaitTermination(120)
        return spark.read.parquet(path)
    run(folder)
    done = run(late)  # the 01:30 event arrives after the window of 01:00 was closed
    assert values(done, "invocations", "errors", "max_latency") == [(1, 0, 5.0), (1, 0, 7.0)]


def test_stream_equals_batch_on_closed_windows(spark):
    rows = [(n, at(n // 4, 10 * (n % 4)), "error" if n % 5 == 0 else "ok", float(n)) for n in range(40)]
    folder = write_batches(spark, rows)
    batch = spark.read.parquet(folder)
    found = streams.run_available(streams.operations(
        streams.read_events(spark, folder, batch.schema), F.col("kind") == "error", "value"), "ops")
    whole = monitor.operations(batch, "ts", F.col("kind") == "error", "value")
    closed = whole.where(F.col("window_start") < F.lit("2024-01-01 08:00:00").cast("timestamp_ntz"))
    columns = ["invocations", "errors", "avg_latency", "max_latency"]
    assert values(found, *columns) == values(closed, *columns)


def test_streams_of_a_file_and_of_a_folder(spark, tmp_path):
    """The table as one file, as a folder of parts with the same name, and missing."""
    rows = [(n, at(n // 4), "ok", float(n)) for n in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    frame.repartition(3).write.parquet(f"{tmp_path}/parts/events.parquet")
    frame.coalesce(1).write.parquet(f"{tmp_path}/one")
    (tmp_path / "single").mkdir()
    next((tmp_path / "one").glob("part-*")).rename(tmp_path / "single" / "events.parquet")
    (tmp_path / "single" / "other.parquet").write_bytes(b"not this one")

    def windows(path):
        stream = streams.operations(streams.read_events(spark, path, frame.schema), F.col("kind") == "error", "value")
        return values(streams.run_available(stream, "ops"), "invocations", "max_latency")
    one = windows(f"{tmp_path}/single/events.parquet")
    assert len(one) > 5 and windows(f"{tmp_path}/parts/events.parquet") == one
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        windows(f"{tmp_path}/empty")


def test_two_streams_join_within_the_delay(spark):
    rows = [(n, at(n // 4, 10 * (n % 4)), "x", float(n)) for n in range(48)]
    folder = write_batches(spark, rows)
    schema = spark.read.parquet(folder).schema
    predictions = streams.read_events(spark, folder, schema).select("event_id", "ts", F.lit(1.0).alias("prediction"))
    # Truths of odd events come two hours late: too late to count.
    shift = F.expr("case when event_id % 2 = 1 then interval 2 hours else interval 0 hours end")
    truths = spark.readStream.schema(schema).parquet(folder).select(
        "event_id", (F.col("ts").cast("timestamp") + shift).alias("truth_ts"),
        F.col("value").alias("label")).withWatermark("truth_ts", "1 hour")
    found = streams.run_available(streams.model_quality_two_streams(
        predictions, truths, "event_id", "truth_ts", evaluate.regression_metrics()), "mq")
    assert found.count() > 5 and {r["n"] for r in found.collect()} == {2}


def test_a_mean_that_equals_the_threshold_is_not_above_it(spark):
    """Added up as doubles, these values exceed 20 times 50 in one order and not in the other."""
    cents = [9877, 123, 4999, 5001, 7013, 2987, 6789, 3211, 9991, 9, 8117, 1883, 5533, 4467, 6061, 3939, 9403, 597, 7777, 2223]
    shares = [x / 100 for x in cents]
    up = next(order for order in (sorted(shares), shares, sorted(shares, reverse=True), shares[::2] + shares[1::2], shares[10:] + shares[:10])
              if sum_as_doubles(order) > 1000.0)
    for order in (up, up[::-1], sorted(up)):
        folder = new_path(spark, "events")
        rows = [(n, at(n % 3), 1, "a", v) for n, v in enumerate(order)]
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(
            f"{folder}/events.parquet")
        found = catalog.QUERIES["model_quality_binary"](spark, folder).first()
        assert (found["tp"], found["fp"], found["fn"], found["tn"]) == (0, 0, 10, 10)
    odd = spark.createDataFrame([(1, 1e30), (1, 2e30), (2, 1e-20), (2, 3e-20), (3, float("nan")), (4, None)], "k int, v double")
    means = {r["k"]: r["m"] for r in odd.groupBy("k").agg(scalars.exact_mean("v").alias("m")).collect()}
    assert means[1] == pytest.approx(1.5e30) and means[2] == pytest.approx(2e-20) and math.isnan(means[3]) and means[4] is None


def sum_as_doubles(values_):
    total = 0.0
    for v in values_:
        total += v
    return total
