"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F


def rolling_bounds(as_of: date | None, days: int) -> tuple[date, date]:
    """First and last day of the window that ends on `as_of` (today when not given)."""
    end = as_of or date.today()
    return end - timedelta(days=days), end


def days_before(day: Column, days: int) -> Column:
    return F.date_format(F.date_sub(day, days), "yyyy-MM-dd")


def blank_to_null(column: str, is_string: bool) -> Column:
    """Empty or blank text counts as missing."""
    c = F.col(column)
    return F.when(F.trim(c) == "", None).otherwise(c).alias(column) if is_string else c


def hash_bucket(*keys: str, buckets: int = 100) -> Column:
    """A bucket in [0, buckets) from the MD5 of the key; equal on every run and engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % F.lit(buckets)


def abs_error(prediction: str, label: str) -> Column:
    return F.abs(F.col(prediction) - F.col(label))


def squared_error(prediction: str, label: str) -> Column:
    return F.pow(F.col(prediction) - F.col(label), F.lit(2.0))


def exact_mean(column: str) -> Column:
    """Aggregate: the mean of doubles by the decimals they are written as, whatever the order they are added in.

    Sums of doubles depend on the order, which a comparison of the mean with a bound can show. Values that are no
    decimals of 18 digits before the point and 10 behind it are averaged as doubles.
    """
    value = F.col(column).cast("double")
    written = F.expr(f"try_cast(cast(`{column}` AS double) AS decimal(28,10))")
    whole = F.when(written.cast("double") == value, written)
    return F.when(F.count(whole) == F.count(value), F.sum(whole).cast("double") / F.count(whole)).otherwise(F.avg(value))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def euclidean(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x * x))


def better_than(current: Column, base: Column, direction: Column) -> Column:
    """Strict comparison by direction; any letter case, and an equal value does not pass."""
    wanted = F.lower(direction)
    return (F.when(wanted == "minimize", current < base)
            .when(wanted == "maximize", current > base)
            .otherwise(F.raise_error(F.concat(F.lit("unknown optimization direction: "),
                                              F.coalesce(direction, F.lit("null")))).cast("boolean")))
