"""Data quality, model quality and operation checks.

Everything that is computed per time window is a list of aggregate columns over
`groupBy(window)`, so the batch form and the streaming form share one definition.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from tasteloom.functions.scalars import hash_bucket

# What is captured by default.
SAMPLING_PERCENTAGE = 20
CAPTURE_KINDS = ("REQUEST", "RESPONSE")


def capture_sample(df: DataFrame, key: str, payloads: dict[str, str],
                   percent: int = SAMPLING_PERCENTAGE, kinds: Sequence[str] = CAPTURE_KINDS) -> DataFrame:
    """(key, kind, payload) for a fixed share of the records, chosen by a hash of the key.

    `payloads` names the column that holds each kind's payload.
    """
    records = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(payloads[k]).cast("string").alias("payload"))
                        for k in kinds])
    return df.where(hash_bucket(key) < percent).select(key, F.inline(records))


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def _stack(rows: list[Column], wide: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return wide.select(*keep, F.inline(F.array(*rows)))


def profile(df: DataFrame, columns: Sequence[str], approx_distinct: bool = False) -> DataFrame:
    """One row per column: completeness, distinct values and, for numbers, their statistics.

    The statistics are one pass. An exact distinct count shuffles a column's distinct values, so
    each gets its own scan of that one column; counting them together would copy every row once
    per column. `approx_distinct` keeps everything in the single pass.
    """
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggregates.append(F.count(c).alias(f"{c}_present"))
        if approx_distinct:
            aggregates.append(F.approx_count_distinct(c).alias(f"{c}_distinct"))
        if _is_number(df, c):
            x = F.col(c).cast("double")
            aggregates += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max"), F.avg(x).alias(f"{c}_mean"),
                           F.stddev_pop(x).alias(f"{c}_stddev"), F.sum(x).alias(f"{c}_sum")]
    none = F.lit(None).cast("double")

    def row(c: str) -> Column:
        stats = [(F.col(f"{c}_{s}") if _is_number(df, c) else none).alias(s)
                 for s in ("min", "max", "mean", "stddev", "sum")]
        share = F.when(F.col("_n") > 0, F.col(f"{c}_present") / F.col("_n"))
        counted = [F.col(f"{c}_distinct").alias("n_distinct")] if approx_distinct else []
        return F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), share.alias("completeness"),
                        *counted, *stats)
    found = _stack([row(c) for c in columns], df.agg(*aggregates))
    if not approx_distinct:
        counts = [df.agg(F.count_distinct(c).alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct")
                  for c in columns]
        found = found.join(reduce(DataFrame.unionByName, counts), "column")
    return found.select("column", "n_rows", "completeness", "n_distinct", "min", "max", "mean", "stddev", "sum")


def suggest_constraints(df: DataFrame, columns: Sequence[str], max_allowed: int = 20) -> DataFrame:
    """Constraint rows from a baseline table.

    completeness (lo = share present), type (lo = share of present values castable to a number),
    non_negative, range (lo, hi), and allowed_values for text columns. A text column with more than
    `max_allowed` values gets a row `values_not_listed` with their number as lo instead; it checks
    nothing, but says so. Rules that a baseline without values cannot give are left out.
    """
    aggregates, rows = [F.count(F.lit(1)).alias("_n")], []
    none, no_list = F.lit(None).cast("double"), F.lit(None).cast("array<string>")

    def row(c: str, kind: str, lo: Column = none, hi: Column = none, allowed: Column = no_list) -> Column:
        return F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"),
                        allowed.alias("allowed"))
    for c in columns:
        x = F.col(c).try_cast("double")
        aggregates.append(F.count(c).alias(f"{c}_present"))
        rows.append(F.when(F.col("_n") > 0, row(c, "completeness", F.try_divide(f"{c}_present", "_n"))))
        aggregates.append(F.count(x).alias(f"{c}_castable"))
        rows.append(F.when(F.col(f"{c}_present") > 0, row(c, "type", F.try_divide(f"{c}_castable", f"{c}_present"))))
        if _is_number(df, c):
            aggregates += [F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
            rows += [F.when(F.col(f"{c}_min") >= 0, row(c, "non_negative", F.lit(0.0))),
                     F.when(F.col(f"{c}_min").isNotNull(), row(c, "range", F.col(f"{c}_min"), F.col(f"{c}_max")))]
    numeric = _stack([F.coalesce(r, F.lit(None)) for r in rows], df.agg(*aggregates)).where("column is not null")
    texts = []
    for c in columns:
        if isinstance(df.schema[c].dataType, StringType):
            values = df.select(F.col(c).alias("_v")).where("_v is not null").distinct()
            # At most max_allowed + 1 values of a text column are ever collected.
            texts.append(values.limit(max_allowed + 1).agg(F.sort_array(F.collect_list("_v")).alias("allowed"))
                         .where(F.size("allowed").between(1, max_allowed))
                         .select(F.lit(c).alias("column"), F.lit("allowed_values").alias("kind"),
                                 none.alias("lo"), none.alias("hi"), "allowed"))
            texts.append(values.agg(F.count("_v").alias("n")).where(F.col("n") > max_allowed)
                         .select(F.lit(c).alias("column"), F.lit("values_not_listed").alias("kind"),
                                 F.col("n").cast("double").alias("lo"), none.alias("hi"), no_list.alias("allowed")))
    return reduce(DataFrame.unionByName, texts, numeric)


def quality_checks(df: DataFrame, constraints: DataFrame) -> tuple[list[Column], list[Column]]:
    """Aggregate columns and violation rows for a set of constraints.

    The constraints are read once here: their number is set by the columns of the baseline,
    not by its rows.
    """
    aggregates, rows = {"_n": F.count(F.lit(1)).alias("_n")}, []
    for r in constraints.where(F.col("column").isin(df.columns)).collect():
        c, kind = r["column"], r["kind"]
        x = F.col(c).try_cast("double")
        checks = []
        if kind == "completeness":
            aggregates[f"{c}_present"] = F.count(c).alias(f"{c}_present")
            checks = [("completeness", F.col(f"{c}_present") / F.col("_n"), r["lo"], True)]
        elif kind == "type":
            aggregates[f"{c}_present"] = F.count(c).alias(f"{c}_present")
            aggregates[f"{c}_castable"] = F.count(x).alias(f"{c}_castable")
            share = F.when(F.col(f"{c}_present") > 0, F.col(f"{c}_castable") / F.col(f"{c}_present"))
            checks = [("type", share, r["lo"], True)]
        elif kind in ("non_negative", "range"):
            aggregates[f"{c}_min"] = F.min(x).alias(f"{c}_min")
            aggregates[f"{c}_max"] = F.max(x).alias(f"{c}_max")
            low = "non_negative" if kind == "non_negative" else "range_low"
            checks = [(low, F.col(f"{c}_min"), r["lo"], True)]
            if kind == "range":
                checks.append(("range_high", F.col(f"{c}_max"), r["hi"], False))
        elif kind == "allowed_values":
            known = F.coalesce(F.col(c).isin(r["allowed"]), F.lit(True))
            aggregates[f"{c}_unknown"] = F.count_if(~known).alias(f"{c}_unknown")
            checks = [("allowed_values", F.col(f"{c}_unknown").cast("double"), 0.0, False)]
        for name, observed, bound, is_floor in checks:
            if bound is None:
                continue
            broken = observed < F.lit(bound) if is_floor else observed > F.lit(bound)
            rows.append(F.when(broken, F.struct(F.lit(c).alias("column"), F.lit(name).alias("kind"),
                                                observed.alias("observed"), F.lit(float(bound)).alias("bound"))))
    return list(aggregates.values()), rows


def data_quality(df: DataFrame, constraints: DataFrame, ts: str, width: str = "1 hour",
                 preprocess: Callable[[DataFrame], DataFrame] | None = None,
                 postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(window_start, column, kind, observed, bound) for every breach of a constraint.

    Works on batch rows and on a stream that carries a watermark. The two hooks transform the
    records before and the violations after the check.
    """
    records = preprocess(df) if preprocess else df
    aggregates, rows = quality_checks(records, constraints)
    per_window = records.groupBy(F.window(ts, width)).agg(*aggregates)
    violations = F.array(*rows).cast("array<struct<column:string,kind:string,observed:double,bound:double>>")
    found = (per_window.select(F.col("window.start").alias("window_start"), F.explode(violations).alias("_v"))
             .where("_v is not null").select("window_start", "_v.*"))
    return postprocess(found) if postprocess else found


def model_quality(joined: DataFrame, ts: str, metrics: Sequence[Column], width: str = "1 hour",
                  preprocess: Callable[[DataFrame], DataFrame] | None = None,
                  postprocess: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Metrics per window over predictions joined with the truth; batch or stream."""
    records = preprocess(joined) if preprocess else joined
    found = (records.groupBy(F.window(ts, width)).agg(*metrics)
             .withColumn("window_start", F.col("window.start")).drop("window"))
    return postprocess(found) if postprocess else found


def suggest_metric_bounds(joined: DataFrame, metrics: Sequence[Column], ceilings: Sequence[str] = (),
                          floors: Sequence[str] = ()) -> DataFrame:
    """(metric, bound, is_floor) from a baseline: its own value of each metric is the highest allowed
    one of `ceilings` (errors) and the lowest of `floors` (accuracies). Metrics that the baseline does
    not define get no bound."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("bound"), F.lit(floor).alias("is_floor"))
            for names, floor in ((ceilings, False), (floors, True)) for m in names]
    return _stack(rows, joined.agg(*metrics)).where("bound is not null")


def metric_breaches(found: DataFrame, bounds: DataFrame) -> DataFrame:
    """(window_start, metric, observed, bound) where a metric of a window is beyond its bound; batch or
    stream. `found` comes from `model_quality`; the bounds, one row per metric, are read once here."""
    rows = []
    for r in bounds.where(F.col("metric").isin(found.columns)).collect():
        observed, bound = F.col(r["metric"]).cast("double"), F.lit(r["bound"])
        rows.append(F.when(observed < bound if r["is_floor"] else observed > bound, F.struct(
            F.lit(r["metric"]).alias("metric"), observed.alias("observed"), bound.alias("bound"))))
    kind = "array<struct<metric:string,observed:double,bound:double>>"
    return (found.select("window_start", F.explode(F.array(*rows).cast(kind)).alias("_v"))
            .where("_v is not null").select("window_start", "_v.*"))


def operations(df: DataFrame, ts: str, is_error: Column, latency: str, width: str = "1 hour") -> DataFrame:
    """Invocations, errors and latency per window; batch or stream."""
    return (df.groupBy(F.window(ts, width))
            .agg(F.count(F.lit(1)).alias("invocations"), F.count_if(is_error).alias("errors"),
                 F.avg(latency).alias("avg_latency"), F.max(latency).alias("max_latency"))
            .withColumn("window_start", F.col("window.start")).drop("window"))


def latest(df: DataFrame, ts: str, key: str, n: int = 20) -> DataFrame:
    """The n newest records, newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)
