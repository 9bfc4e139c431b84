import numpy as np
import pytest
from pyspark.errors import PySparkException

from helpers import values
from tasteloom.functions import scalars
from tasteloom.operators import evaluate
from pyspark.sql import functions as F


def gate(spark, current, base, direction):
    metrics = spark.createDataFrame([("m", current)], "metric string, current_value double")
    targets = spark.createDataFrame([("m", direction, base)], "metric string, direction string, base_value double")
    return evaluate.validation_gate(metrics, targets)


@pytest.mark.parametrize("current, direction, passed", [
    (1.0, "Minimize", True), (2.0, "minimize", False), (3.0, "MINIMIZE", False), (3.0, "Maximize", True),
    (2.0, "maximize", False)])
def test_gate_is_strict(spark, current, direction, passed):
    found = gate(spark, current, 2.0, direction)
    assert found.first()["passed"] is passed
    if not passed:
        with pytest.raises(ValueError):
            evaluate.require_passed(found)


def test_gate_needs_a_known_direction_and_a_value(spark):
    with pytest.raises(PySparkException, match="direction"):
        gate(spark, 1.0, 2.0, "sideways").collect()
    assert gate(spark, None, 2.0, "Minimize").first()["passed"] is False


def test_metrics(spark):
    pick = np.random.default_rng(1)
    label, pred = pick.normal(size=200), pick.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(label, pred)], "label double, prediction double")
    m = df.agg(*evaluate.regression_metrics()).first()
    mse = ((label - pred) ** 2).mean()
    assert np.allclose([m["mae"], m["mse"], m["rmse"], m["r2"]],
                       [np.abs(label - pred).mean(), mse, mse ** 0.5, 1 - mse / label.var()])
    exact = dict(values(evaluate.abs_error_percentiles(df)))
    assert abs(exact[0.5] - np.percentile(np.abs(label - pred), 50)) < 1e-12
    near = dict(values(evaluate.abs_error_percentiles(df, exact=False)))
    assert abs(near[0.9] - exact[0.9]) < 0.1
    assert df.withColumn("label", F.lit(1.0)).agg(*evaluate.regression_metrics()).first()["r2"] is None


def test_binary_metrics(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] * 2 + [(0, 1)] + [(0, 0)] * 4, "predicted int, actual int")
    m = df.agg(*evaluate.binary_metrics()).first()
    assert (m["tp"], m["fp"], m["fn"], m["tn"]) == (3, 2, 1, 4)
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.7, 0.6, 0.75)
    assert values(evaluate.confusion(df)) == [(0, 0, 4), (0, 1, 2), (1, 0, 1), (1, 1, 3)]
    empty = df.where("predicted = 0 and actual = 0").agg(*evaluate.binary_metrics()).first()
    assert empty["precision"] is None and empty["accuracy"] == 1.0


def test_scalar_functions(spark):
    row = spark.range(1).select(
        scalars.days_before(F.lit("2024-03-01").cast("date"), 1).alias("d"),
        scalars.dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("dot"),
        scalars.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("l2")).first()
    assert (row["d"], row["dot"], row["l2"]) == ("2024-02-29", 11.0, 5.0)


def test_metrics_by_problem_type(spark):
    df = spark.createDataFrame([(0.9, 1, 1.0), (0.2, 0, 0.5), (0.7, 0, 0.0)], "p double, truth int, guess double")
    m = df.agg(*evaluate.metrics_for("BinaryClassification", "truth", probability_attribute="p")).first()
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (1, 1, 1, 0)
    assert df.agg(*evaluate.metrics_for("Regression", "truth", "guess")).first()["mae"] == 0.5 / 3
    assert df.agg(*evaluate.metrics_for("MulticlassClassification", "truth", "guess")).first()["accuracy"] == 2 / 3
    with pytest.raises(ValueError):
        evaluate.metrics_for("Ranking", "truth")
