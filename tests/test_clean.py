import pytest
from pyspark.errors import PySparkException

from helpers import values
from tasteloom.operators import clean

ROWS = "user_id string, q string, item_id string, grp string, ticker string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([
        ("u1", "1", "a", "G", "AAA"), ("u1", "2", "b", "G", None), ("u2", "", "a", "G", "AAA"),
        ("u2", "3", " ", "G", "AAA"), ("u3", "4", "c", "G", "PESOS"), ("u4", "5", "d", None, "BBB")], ROWS)


def test_null_ticker_passes_the_exclusion(rows):
    assert values(clean.exclude(rows, "ticker", ["PESOS"]), "item_id", "ticker").count(("b", None)) == 1


def test_blank_and_null_values_are_incomplete(rows):
    kept = clean.clean_interactions(rows)
    assert values(kept) == [("u1", "1", "a", "G"), ("u1", "2", "b", "G")]


def test_kept_ticker_takes_part_in_the_check(rows):
    kept = clean.clean_interactions(rows, ["PESOS", "DOLAR"], keep_ticker=True)
    assert values(kept, "item_id") == [("a",)]


def test_date_cut_ends(spark):
    days = spark.createDataFrame([("2020-10-31",), ("2020-11-01",), ("2020-11-02",)], "d string").selectExpr(
        "cast(d as date) d")
    bounds = ("2020-01-01", "2020-11-01"), ("2020-11-01", "2020-12-31")
    train, test = clean.date_cut(days, "d", *bounds)
    assert (train.count(), test.count()) == (2, 2)  # the boundary row is in both
    train, test = clean.date_cut(days, "d", *bounds, half_open=True)
    assert (train.count(), test.count()) == (1, 2)


def test_recode(spark):
    df = spark.createDataFrame([("x",), ("y",), (None,)], "c string")
    assert values(clean.recode(df, "c", ["y", "x"])) == [(None,), (0,), (1,)]
    with pytest.raises(PySparkException, match="unknown c"):
        clean.recode(df, "c", ["y"]).collect()


def test_header_row_and_types(spark):
    df = spark.createDataFrame([("id", "v"), ("1", "2.5"), (None, "x")], "id string, v string")
    plain = clean.drop_header_rows(df, "id")
    assert plain.count() == 2
    assert values(clean.typed(plain, {"id": "int", "v": "double"}, strict=False)) == [(None, None), (1, 2.5)]
    with pytest.raises(PySparkException):
        clean.typed(plain, {"v": "double"}).collect()
