"""Joining predictions with the truth, metrics, and the acceptance gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tasteloom.functions.scalars import abs_error, better_than, squared_error
from tasteloom.operators.order import percentiles


def join_truth(predictions: DataFrame, truth: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Predictions with their labels. A skewed key is split at run time when both sides are tables."""
    return predictions.join(truth, key, "inner")


def regression_metrics(prediction: str = "prediction", label: str = "label") -> list[Column]:
    """Aggregate columns: n, mae, mse, rmse, r2. Usable with any grouping, also on streams."""
    mse = F.avg(squared_error(prediction, label))
    spread = F.var_pop(label)
    return [F.count(F.lit(1)).alias("n"), F.avg(abs_error(prediction, label)).alias("mae"),
            mse.alias("mse"), F.sqrt(mse).alias("rmse"),
            F.when(spread > 0, F.lit(1.0) - mse / spread).alias("r2")]


def rmse(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(F.sqrt(F.avg(squared_error(prediction, label))).alias("rmse"))


def binary_metrics(prediction: str | Column = "predicted", label: str = "actual") -> list[Column]:
    """Aggregate columns for 0/1 predictions: the four counts and the usual ratios."""
    guess = F.col(prediction) if isinstance(prediction, str) else prediction

    def hits(p: int, a: int) -> Column:
        return F.count_if((guess == p) & (F.col(label) == a))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole)
    tp, fp, fn, tn = hits(1, 1), hits(1, 0), hits(0, 1), hits(0, 0)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"),
            ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
            ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
            ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def metrics_for(problem_type: str, ground_truth_attribute: str, inference_attribute: str | None = None,
                probability_attribute: str | None = None, threshold: float = 0.5) -> list[Column]:
    """Aggregate columns for a kind of problem; a probability is cut at `threshold`."""
    if problem_type == "Regression":
        return regression_metrics(inference_attribute, ground_truth_attribute)
    if problem_type == "BinaryClassification":
        guess = (F.col(inference_attribute) if inference_attribute
                 else (F.col(probability_attribute) >= threshold).cast("int"))
        return binary_metrics(guess, ground_truth_attribute)
    if problem_type == "MulticlassClassification":
        right = F.count_if(F.col(inference_attribute) == F.col(ground_truth_attribute))
        return [F.count(F.lit(1)).alias("n"), (right / F.count(F.lit(1))).alias("accuracy")]
    raise ValueError(f"unknown problem type: {problem_type}")


def confusion(df: DataFrame, prediction: str = "predicted", label: str = "actual") -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))


def abs_error_percentiles(df: DataFrame, prediction: str = "prediction", label: str = "label",
                          shares: Sequence[float] = (0.1, 0.5, 0.9), exact: bool = True,
                          accuracy: int = 10_000) -> DataFrame:
    """(share, value) of the absolute error."""
    errors = df.select(abs_error(prediction, label).alias("abs_error"))
    if exact:
        return percentiles(errors, "abs_error", shares)
    sketch = F.percentile_approx("abs_error", list(shares), accuracy)
    pairs = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), sketch.alias("value"))
    return errors.agg(pairs.alias("p")).select(F.inline("p")).toDF("share", "value")


def validation_gate(metrics: DataFrame, targets: DataFrame) -> DataFrame:
    """metrics (metric, current_value) against targets (metric, direction, base_value).

    A metric that was not measured does not pass.
    """
    passed = better_than(F.col("current_value"), F.col("base_value"), F.col("direction"))
    return (targets.join(metrics, "metric", "left")
            .select("metric", "direction", "base_value", "current_value",
                    F.coalesce(passed, F.lit(False)).alias("passed")))


def require_passed(gate: DataFrame) -> None:
    """Raise when a metric of the gate failed."""
    failed = gate.where(~F.col("passed")).collect()  # a row per target
    if failed:
        raise ValueError(f"validation failed: {[r.asDict() for r in failed]}")
