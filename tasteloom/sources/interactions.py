"""Sources of interaction rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from tasteloom.functions.scalars import rolling_bounds


def load_interactions(spark: SparkSession, sql: str, as_of: date | None, days: int,
                      **tables: DataFrame) -> DataFrame:
    """Run a query over the window of `days` that ends on `as_of`.

    The text names the bounds `{{date_from}}` / `{{date_to}}` (or `:date_from` / `:date_to`).
    They are bound as date parameters rather than pasted in, and reach the scan as a pushed
    filter. DataFrames given by keyword are available as `{name}`.
    """
    first, last = rolling_bounds(as_of, days)
    return load_range(spark, sql, first, last, **tables)


def load_range(spark: SparkSession, sql: str, date_from: date, date_to: date,
               **tables: DataFrame) -> DataFrame:
    """The same with fixed bounds."""
    text = sql.replace("{{date_from}}", ":date_from").replace("{{date_to}}", ":date_to")
    return spark.sql(text, args={"date_from": date_from, "date_to": date_to}, **tables)
