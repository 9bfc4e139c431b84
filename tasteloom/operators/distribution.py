"""Distributions kept as small sketches per window, which merge into baselines without reading rows again.

A table of one row per window and column holds counts, a KLL sketch of the numbers and an HLL sketch of the
distinct values. Beside the exact profiles and percentiles (`monitor.profile`, `order.percentiles`), for data
too large to be read once more per question. With K = 800 a quantile's rank is off by at most half a
percent in nearly all cases (tested), with HLL of 4,096 cells a distinct count by five percent.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

K = 800
_CARRIED = ("n_rows", "n_present", "n_numbers", "total", "min", "max")


def sketch(df: DataFrame, columns: Sequence[str], ts: str = "ts", width: str = "1 hour", k: int = K) -> DataFrame:
    """(window_start, column, n_rows, n_present, n_numbers, total, min, max, quantiles, distinct) in one pass.

    The sketches are made before the shuffle, so a window of any size sends little. Null is absent; NaN
    and infinite values are present and distinct but no numbers. Text columns have no quantiles. Rows
    without a time are in no window.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("_n")], []
    for i, c in enumerate(columns):
        value = F.col(c).cast("double") if isinstance(df.schema[c].dataType, NumericType) else F.lit(None).cast("double")
        number = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
        aggregates += [F.count(c).alias(f"_p{i}"), F.count(number).alias(f"_c{i}"), F.sum(number).alias(f"_s{i}"),
                       F.min(number).alias(f"_l{i}"), F.max(number).alias(f"_h{i}"),
                       F.kll_sketch_agg_double(number, F.lit(k)).alias(f"_q{i}"),
                       F.hll_sketch_agg(F.col(c).cast("string")).alias(f"_d{i}")]
        names = ("n_present", "n_numbers", "total", "min", "max", "quantiles", "distinct")
        rows.append(F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"),
                             *[F.col(f"_{f}{i}").alias(n) for f, n in zip("pcslhqd", names)]))
    found = df.groupBy(F.window(ts, width)["start"].alias("window_start")).agg(*aggregates)
    return found.select("window_start", F.inline(F.array(*rows)))


def merge(sketches: DataFrame, *by: str) -> DataFrame:
    """One row per column (and `by`, such as a day) from the rows of many windows."""
    sums = [F.sum(c).alias(c) for c in _CARRIED[:4]] + [F.min("min").alias("min"), F.max("max").alias("max")]
    return sketches.groupBy(*by, "column").agg(
        *sums, F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"))


def _quantile(share: float) -> Column:
    return F.when(F.col("n_numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(share))))


def describe(sketches: DataFrame, shares: Sequence[float] = (0.1, 0.5, 0.9), by: Sequence[str] = ()) -> DataFrame:
    """(column, n_rows, completeness, n_distinct, min, max, mean, quantiles) of sketched or merged rows; the
    last is an array of (share, value) structs, the values null where a column has no numbers."""
    found = F.array(*[F.struct(F.lit(float(s)).alias("share"), _quantile(s).alias("value")) for s in shares])
    return sketches.select(
        *by, "column", "n_rows", (F.col("n_present") / F.col("n_rows")).alias("completeness"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"), "min", "max",
        F.when(F.col("n_numbers") > 0, F.col("total") / F.col("n_numbers")).alias("mean"), found.alias("quantiles"))


def drift(sketches: DataFrame, baseline: DataFrame, shares: Sequence[float] = tuple(n / 20 for n in range(1, 20))) -> DataFrame:
    """(window_start, column, distance): the largest difference between the share of a window's numbers, and of
    the baseline's, that lie at or below one of the baseline's quantiles: 0 for the same distribution, near 1 for
    another place. Windows and baselines without numbers have no distance. `baseline` is merged: a row per column.
    """
    first = baseline.where("n_numbers > 0")
    points = {r["column"]: list(r["_points"]) for r in first.select(  # one short row per column; ranks are asked at constants
        "column", F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(s))) for s in shares]).alias("_points")).collect()}
    if not points:
        return sketches.where("false").select("window_start", "column", F.lit(0.0).alias("distance"))
    ranks = F.coalesce(*[F.when(F.col("column") == c, F.array(*[F.kll_sketch_get_rank_double("quantiles", F.lit(p)) for p in at]))
                         for c, at in points.items()]).alias("_ranks")
    known = first.select("column", ranks.alias("_baseline"))
    return sketches.where("n_numbers > 0").select("window_start", "column", ranks).join(known, "column").select(
        "window_start", "column",
        F.array_max(F.zip_with("_ranks", "_baseline", lambda a, b: F.abs(a - b))).alias("distance"))
