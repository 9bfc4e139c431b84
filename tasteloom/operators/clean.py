"""Row and column cleaning of the interaction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tasteloom.functions.scalars import blank_to_null

# The tickers that stand for currencies, and the class labels in code order.
CURRENCY_TICKERS = ("PESOS", "DOLAR")
CLASS_LABELS = ("Iris-versicolor", "Iris-setosa", "Iris-virginica")


def exclude(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop rows whose `column` is one of `values`; a null value stays."""
    return df.where(~F.coalesce(F.col(column).isin(list(values)), F.lit(False)))


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing or blank value in the given columns (default: all)."""
    blanked = df.select([blank_to_null(f.name, isinstance(f.dataType, StringType)) for f in df.schema])
    return blanked.dropna(subset=list(columns or df.columns))


def clean_interactions(df: DataFrame, excluded: Sequence[str] = CURRENCY_TICKERS, keep_ticker: bool = False,
                       ticker: str = "ticker") -> DataFrame:
    """Exclude pseudo items, then drop incomplete rows over the columns that are kept.

    With `keep_ticker=False` the ticker goes first, so a row that lacks only the ticker stays.
    """
    rows = exclude(df, ticker, excluded)
    return drop_incomplete(rows if keep_ticker else rows.drop(ticker))


def date_cut(df: DataFrame, ts: str, train: tuple[str, str], test: tuple[str, str],
             half_open: bool = False) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by date. Both ends are included unless `half_open`."""
    def part(bounds: tuple[str, str]) -> DataFrame:
        kind = df.schema[ts].dataType
        low, high = (F.lit(b).cast(kind) for b in bounds)
        upper = F.col(ts) < high if half_open else F.col(ts) <= high
        return df.where((F.col(ts) >= low) & upper)
    return part(train), part(test)


def mark_date_cut(df: DataFrame, ts: str, train: tuple[str, str], test: tuple[str, str],
                  half_open: bool = False) -> DataFrame:
    """The same in one pass: `split` is `train` or `test`, and a row that both cover comes twice."""
    kind = df.schema[ts].dataType

    def inside(bounds: tuple[str, str]):
        low, high = (F.lit(b).cast(kind) for b in bounds)
        return (F.col(ts) >= low) & ((F.col(ts) < high) if half_open else (F.col(ts) <= high))
    names = F.array(F.when(inside(train), "train"), F.when(inside(test), "test"))
    return df.withColumn("split", F.explode(F.array_compact(names)))


def recode(df: DataFrame, column: str, labels: Sequence[str] = CLASS_LABELS, out: str | None = None) -> DataFrame:
    """Replace each label by its place in `labels`; an unknown label is an error."""
    cases = F.when(F.col(column) == labels[0], 0)
    for code, label in enumerate(labels[1:], start=1):
        cases = cases.when(F.col(column) == label, code)
    known = F.when(F.col(column).isNull(), F.lit(None).cast("int"))
    unknown = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.col(column).cast("string")))
    return df.withColumn(out or column, F.coalesce(known, cases.when(F.col(column).isNotNull(), unknown.cast("int"))))


def drop_header_rows(df: DataFrame, column: str, drop: Sequence[str] = ()) -> DataFrame:
    """Drop rows that repeat the column name as data, and the columns in `drop`."""
    is_header = F.coalesce(F.col(column).cast("string") == F.lit(column), F.lit(False))
    return df.where(~is_header).drop(*drop)


def typed(df: DataFrame, types: dict[str, str], strict: bool = True) -> DataFrame:
    """Cast columns. `strict` fails on bad input, otherwise it becomes null."""
    def one(name: str):
        if name not in types:
            return F.col(name)
        cast = F.col(name).cast if strict else F.col(name).try_cast
        return cast(types[name]).alias(name)
    return df.select([one(c) for c in df.columns])
